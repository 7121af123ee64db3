"""Family counts of shapes from one table.

``family_facts`` has a row for each shape, family and region. Spread, region shares and
"shared elsewhere" are sums over it. Kept in buckets of the shape (``plans.published``), none of them
shuffles by shape again, and none takes a distinct of the postings. Rows, not bitmaps: most
shapes have a few families, for which a bitmap of Spark's size (4 KB) is the larger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape.operators.explore import region_name, region_shares, regions_of
from lexshape.operators.index import family_or_self


def family_facts(postings: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages per (shape, fam, region); ``named`` is 0 for a language without a family. ``postings`` have a language once per shape."""
    named = (F.coalesce("family", F.lit("")) != "").cast("int").alias("named")
    fams = family_or_self(languages).join(languages.select("glottocode", named, region_name().alias("region")), "glottocode")
    return postings.select("shape", "glottocode").join(fams, "glottocode").groupBy("shape", "fam", "region").agg(
        F.count(F.lit(1)).alias("languages"), F.max("named").alias("named"))


def spread(facts: DataFrame) -> DataFrame:
    """Languages and families per shape, as ``explore.family_spread`` gives them."""
    per_family = facts.groupBy("shape", "fam").agg(F.sum("languages").alias("n"), F.max("named").alias("named"))
    return per_family.groupBy("shape").agg(F.sum("n").alias("languages"), F.sum("named").alias("families"),
                                           F.count(F.lit(1)).alias("families_or_self"))


def spread_elsewhere(facts: DataFrame, postings: DataFrame) -> DataFrame:
    """Per (language, shape): other languages and families that share it. A language is one of its own family-or-self."""
    totals = spread(facts).select("shape", "languages", "families_or_self")
    return postings.select("shape", "glottocode").join(totals, "shape").select(
        "glottocode", "shape", (F.col("languages") - 1).alias("other_languages"), (F.col("families_or_self") - 1).alias("other_families"))


def region_share(facts: DataFrame, postings: DataFrame, languages: DataFrame, unit: str = "families") -> DataFrame:
    """As ``explore.region_share``: a region's families of a shape are its rows here, its languages their sum."""
    hits = F.count(F.lit(1)) if unit == "families" else F.sum("languages")
    return region_shares(facts.select("shape").distinct(), facts.groupBy("shape", "region").agg(hits.alias("hits")),
                         regions_of(postings.select("glottocode").distinct(), languages, unit)[1])
