"""Yield rates: intervals, rankings, funnels, typology and facet counts.

Input: languages with ``form_count`` (k), ``examined`` (n) and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions import stats as ST


def with_rates(languages: DataFrame) -> DataFrame:
    """Add ``rate`` and its 95% interval ``rate_lo``, ``rate_hi``."""
    k, n = F.col("form_count"), F.col("examined")
    low, high = ST.wilson(k, n)
    return languages.withColumns({"rate": ST.rate(k, n), "rate_lo": low, "rate_hi": high})


def rank_languages(languages: DataFrame, limit: int | None = None) -> DataFrame:
    """Languages by kind of sample, then by the lower bound of their rate (ties by code); the first ``limit`` if given."""
    out = with_rates(languages).orderBy(
        ST.ordinal(F.col("sample"), K.SAMPLE_ORDER), F.desc("rate_lo"), F.desc("examined"), "glottocode")
    return out.limit(limit) if limit else out


def _funnel_points(languages: DataFrame, sample: str) -> DataFrame:
    return languages.where((F.col("examined") > 0) & (F.col("sample") == sample))


def funnel(languages: DataFrame, sample: str = "word list") -> DataFrame:
    """Each language against the 95% limits around the common rate of its kind of sample.

    Empty below ten points. The common rate is a scalar subquery, so the
    languages are never gathered."""
    pts = _funnel_points(languages, sample)
    total = pts.agg(F.count(F.lit(1)).alias("points"), (F.sum("form_count") / F.sum("examined")).alias("p0"))
    p0 = total.select("p0").scalar()
    points = total.select("points").scalar()
    width = F.col("p0") * (1 - F.col("p0")) / F.col("examined")
    out = pts.where(points >= K.MIN_FUNNEL_POINTS).withColumn("p0", p0).withColumns({
        "rate": ST.rate(F.col("form_count"), F.col("examined")),
        "limit_lo": F.greatest(F.lit(0.0), F.col("p0") - K.Z95 * F.sqrt(width)),
        "limit_hi": F.least(F.lit(1.0), F.col("p0") + K.Z95 * F.sqrt(width))})
    return out.withColumn("position", F.when(F.col("rate") > F.col("limit_hi"), "above")
                          .when(F.col("rate") < F.col("limit_lo"), "below").otherwise("inside"))


def funnel_summary(languages: DataFrame, sample: str = "word list") -> DataFrame:
    """Points, common rate and the share outside the funnel."""
    f = funnel(languages, sample)
    return f.agg(
        F.count(F.lit(1)).alias("points"), F.max("p0").alias("p0"),
        F.count_if(F.col("position") == "above").alias("above"), F.count_if(F.col("position") == "below").alias("below"),
        (F.count_if(F.col("position") != "inside") / F.count(F.lit(1))).alias("outside")).where("points > 0")


def typology_quartiles(languages: DataFrame, sample: str = "word list") -> DataFrame:
    """Quartiles of the rate per syllable class, among large enough samples of one kind.

    A quartile is the element at ``floor(f * n)`` of the sorted rates (the last
    one at most). It is picked by rank over counted distinct rates, so no class
    is gathered into a list: ``n`` comes from an aggregate, the element from the
    first rate whose running count passes the index."""
    klass = F.coalesce(F.col("syllable_structure"), F.lit("")).alias("syllable_structure")
    rates = languages.where((F.col("sample") == sample) & (F.col("examined") >= K.MIN_QUARTILE_EXAMINED)).select(
        klass, ST.rate(F.col("form_count"), F.col("examined")).alias("rate"))
    by = "syllable_structure"
    counted = rates.groupBy(by, "rate").agg(F.count(F.lit(1)).alias("n"))
    # two-level running count: 1024 equal slices of [0, 1], then inside a slice
    counted = counted.withColumn("slice", F.floor(F.col("rate") * 1024))
    slices = counted.groupBy(by, "slice").agg(F.sum("n").alias("sn"))
    before = slices.select(by, "slice", F.coalesce(F.sum("sn").over(
        Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.col("before") + F.sum("n").over(
        Window.partitionBy(by, "slice").orderBy("rate").rowsBetween(Window.unboundedPreceding, 0))
    totals = rates.groupBy(by).agg(F.count(F.lit(1)).alias("languages"))
    placed = counted.join(before, [by, "slice"]).withColumn("upto", upto).join(totals, by)

    def pick(f: float) -> Column:
        at = F.least(F.col("languages") - 1, F.floor(F.col("languages") * f))
        return F.min(F.when(F.col("upto") > at, F.col("rate")))
    return placed.groupBy(by).agg(
        F.max("languages").alias("languages"), pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")
    ).withColumn("readable", F.col("languages") >= K.MIN_CLASS_SIZE)


def typology_order(quartiles: DataFrame) -> DataFrame:
    """Readable known classes by median, and whether all three agree with simple > moderate > complex."""
    known = quartiles.where("readable and syllable_structure <> ''")
    at = F.struct((-F.col("median")).alias("m"), ST.ordinal(F.col("syllable_structure"), K.SYLLABLE_ORDER).alias("o"),
                  "syllable_structure")
    order = F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["syllable_structure"]), " > ")
    return known.agg(order.alias("ordering"), F.count(F.lit(1)).alias("classes")).select(
        "ordering", "classes", (F.col("ordering") == " > ".join(K.SYLLABLE_ORDER[:3])).alias("agrees"))


def facet_counts(languages: DataFrame) -> DataFrame:
    """Languages per region, family, sample, syllable class and tone flag, long form, in one pass."""
    facets = {
        "region": F.coalesce(F.col("macroarea"), F.lit("")), "family": F.coalesce(F.col("family"), F.lit("")),
        "sample": F.nullif(F.coalesce(F.col("sample"), F.lit("")), F.lit("")),
        "syllable": F.coalesce(F.col("syllable_structure"), F.lit("")),
        "tone": F.when(F.col("tone_marked"), "yes").otherwise("no"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in facets.items()]))
    return languages.select(pairs.alias("x")).select("x.*").where("value is not null").groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("languages"))


def map_points(languages: DataFrame) -> DataFrame:
    """Equal Earth coordinates; languages without a place stay, unmapped."""
    x, y = ST.equal_earth(F.col("longitude"), F.col("latitude"))
    return languages.withColumns({"x": x, "y": y, "mapped": x.isNotNull()})
