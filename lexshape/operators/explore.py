"""Questions over the finished index: grids, spreads, rankings, comparisons.

Postings are flat ``(shape, glottocode, tier_rank, ...)`` rows. Counts of
languages and families are exact; every query pre-aggregates to distinct
(group, language) rows before it counts families, so one hot shape or language
is spread over tasks by the two-step aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexshape import constants as K
from lexshape.functions import stats as ST
from lexshape.operators.index import family_or_self
from lexshape.operators.ranking import rank_within


def filter_onsets(shapes: DataFrame, onsets: list[str]) -> DataFrame:
    return shapes.where(F.col("onset_class").isin(*onsets))


def filter_tiers(postings: DataFrame, tiers: list[str]) -> DataFrame:
    return postings.where(F.col("tier_rank").isin(*[K.TIERS.index(t) for t in tiers]))


def filter_languages(languages: DataFrame, **facets: str | bool | None) -> DataFrame:
    """Keep languages that match every given facet; None means any, '' is a real value."""
    out = languages
    for column, value in facets.items():
        if value is None:
            continue
        c = F.col(column)
        out = out.where(F.coalesce(c, F.lit(False)) == value if isinstance(value, bool)
                        else F.coalesce(c, F.lit("")) == value)
    return out


def search_languages(languages: DataFrame, text: str) -> DataFrame:
    """Case-insensitive part of the name or the alias."""
    q = F.lit(text.strip().lower())
    return languages.where(F.lower("name").contains(q) | F.lower(F.coalesce("alias", F.lit(""))).contains(q))


def search_meanings(concepts: DataFrame, text: str, column: str = "label") -> DataFrame:
    return concepts.where(F.lower(column).contains(F.lit(text.strip().lower())))


def language_best(postings: DataFrame, by: list[str]) -> DataFrame:
    """Each language once per group, at its best tier."""
    return postings.groupBy(*by, "glottocode").agg(F.min("tier_rank").alias("tier_rank"))


def tier_composition(postings: DataFrame, by: list[str]) -> DataFrame:
    """Languages per group by their best tier."""
    counts = [F.count_if(F.col("tier_rank") == i).alias(t) for i, t in enumerate(K.TIERS)]
    return language_best(postings, by).groupBy(*by).agg(F.count(F.lit(1)).alias("languages"), *counts)


def family_spread(postings: DataFrame, languages: DataFrame, by: list[str]) -> DataFrame:
    """Languages and families per group. ``families`` leaves blank families out;
    ``families_or_self`` counts a language without one as its own."""
    fams = family_or_self(languages).join(languages.select("glottocode", "family"), "glottocode")
    used = postings.select(*by, "glottocode").distinct().join(fams, "glottocode")
    per_family = used.groupBy(*by, "fam").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("family") != "", 1).otherwise(0)).alias("named"))
    return per_family.groupBy(*by).agg(
        F.sum("n").alias("languages"), F.sum("named").alias("families"),
        F.count(F.lit(1)).alias("families_or_self"))


def heatmap(shapes: DataFrame, postings: DataFrame, languages: DataFrame) -> DataFrame:
    """Onset by vowel grid: languages, families, tier composition, evidence step.

    Only filled cells have rows; ``heatmap_grid`` adds the empty ones."""
    by = ["onset_class", "nucleus_bucket"]
    cells = postings.join(shapes.select("shape", *by), "shape")
    best = language_best(cells, by).join(languages.select("glottocode", "family"), "glottocode")
    counts = [F.sum(t).alias(t) for t in K.TIERS]
    per_family = best.groupBy(*by, "family").agg(
        F.count(F.lit(1)).alias("languages"),
        *[F.count_if(F.col("tier_rank") == i).alias(t) for i, t in enumerate(K.TIERS)])
    out = per_family.groupBy(*by).agg(
        F.sum("languages").alias("languages"), F.count_if(F.col("family") != "").alias("families"), *counts)
    return out.withColumn("step", ST.evidence_step(F.col("families")))


def heatmap_axes(spark) -> DataFrame:
    """All cells of the grid: onset classes by vowel buckets, in their orders."""
    rows = [(o, n, i, j) for i, o in enumerate(K.ONSET_ORDER) for j, n in enumerate(K.NUCLEUS_ORDER)]
    return spark.createDataFrame(rows, "onset_class string, nucleus_bucket string, onset_ord int, nucleus_ord int")


def heatmap_grid(cells: DataFrame) -> DataFrame:
    """The full grid: cells without any language have zeros and no evidence step."""
    by = ["onset_class", "nucleus_bucket"]
    counts = [c for c in cells.columns if c not in (*by, "step")]
    full = cells.join(heatmap_axes(cells.sparkSession).select(*by), by, "full").fillna(0, counts)
    return full.withColumn("step", ST.evidence_step(F.col("families"))).select(*cells.columns)


def heatmap_pivot(cells: DataFrame, value: str = "families") -> DataFrame:
    """The grid as a table: one row per onset, one column per vowel bucket."""
    return cells.groupBy("onset_class").pivot("nucleus_bucket", list(K.NUCLEUS_ORDER)).agg(F.first(value)).fillna(0)


def inventory_cells(inventories: DataFrame) -> DataFrame:
    """Cells a language's sounds could fill; no consonant is needed for ``none``.

    At most (onset classes x vowel buckets) rows per language: both lists hold
    class names out of fixed sets."""
    onsets = F.array_union(F.col("onsets"), F.array(F.lit("none")))
    return inventories.select("glottocode", F.explode(onsets).alias("onset_class"), "nuclei").select(
        "glottocode", "onset_class", F.explode("nuclei").alias("nucleus_bucket"))


def observed_share(cells: DataFrame, inventories: DataFrame, languages: DataFrame) -> DataFrame:
    """Per cell: families using both sounds together, out of the families whose
    inventories have both, and that share against the pooled one.

    ``cells`` are (glottocode, onset_class, nucleus_bucket) rows in use. Only languages
    count of which words were examined (``examined`` of ``languages``)."""
    by = ["onset_class", "nucleus_bucket"]
    fams = family_or_self(languages.where("examined > 0"))
    axes_o = cells.select("onset_class").distinct()
    axes_n = cells.select("nucleus_bucket").distinct()
    could = (inventory_cells(inventories).join(axes_o, "onset_class", "left_semi")
             .join(axes_n, "nucleus_bucket", "left_semi"))
    uses = cells.select("glottocode", *by).distinct().withColumn("_use", F.lit(1))
    both = could.join(uses, ["glottocode", *by], "left").join(fams, "glottocode")
    per_family = both.groupBy(*by, "fam").agg(F.coalesce(F.max("_use"), F.lit(0)).alias("use"))
    grid = per_family.groupBy(*by).agg(F.sum("use").alias("use"), F.count(F.lit(1)).alias("could"))
    usual = grid.agg((F.sum("use") / F.sum("could")).alias("usual")).scalar()
    ratio = F.when((F.col("could") > 0) & (usual > 0), F.col("use") / F.col("could") / usual).otherwise(F.lit(0.0))
    return grid.withColumn("ratio", ratio).withColumn(
        "verdict", F.when(F.col("could") >= K.MIN_CELL_FAMILIES, ST.share_verdict(F.col("ratio"))))


def region_name() -> Column:
    return F.coalesce(F.nullif(F.col("macroarea"), F.lit("")), F.lit("Unlisted"))


def regions_of(able: DataFrame, languages: DataFrame, unit: str = "families") -> tuple[DataFrame, DataFrame]:
    """(glottocode, region, fam) of the languages in ``able``, and (region, total) of the regions that are not thin."""
    langs = languages.join(able, "glottocode", "left_semi")
    langs = langs.select("glottocode", region_name().alias("region")).join(family_or_self(langs), "glottocode")
    base = langs.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fam" if unit == "families" else "glottocode").alias("total"))
    base = base.where((F.col("n") >= K.MIN_REGION_LANGUAGES)
                      & ((F.col("total") >= K.MIN_REGION_FAMILIES) if unit == "families" else F.lit(True)))
    return langs, base.select("region", "total")


def region_shares(shapes: DataFrame, hits: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, shape, hits, total, share), also where a region has none.

    The regions, a handful, come as a list to each shape, so nothing is shuffled by region alone."""
    listed = regions.agg(F.collect_list(F.struct("region", "total")).alias("r")).select("r").scalar()
    asked = shapes.select("shape", F.explode(listed).alias("x")).select("shape", "x.region", "x.total")
    return (asked.join(hits, ["shape", "region"], "left").fillna(0, ["hits"])
            .select("region", "shape", "hits", "total", (F.col("hits") / F.col("total")).alias("share")))


def region_share(postings: DataFrame, languages: DataFrame, unit: str = "families") -> DataFrame:
    """Share of each region's families (or languages) that have each shape, also where none has.

    The denominator is every language with any open form; thin regions are left out."""
    langs, regions = regions_of(postings.select("glottocode").distinct(), languages, unit)
    hits = postings.select("shape", "glottocode").distinct().join(langs, "glottocode").groupBy("shape", "region").agg(
        F.count_distinct("fam" if unit == "families" else "glottocode").alias("hits"))
    return region_shares(postings.select("shape").distinct(), hits, regions)


def language_index(postings: DataFrame) -> DataFrame:
    """Per language: its shapes by tier."""
    return postings.groupBy("glottocode").agg(
        F.count(F.lit(1)).alias("shapes"),
        *[F.count_if(F.col("tier_rank") == i).alias(t) for i, t in enumerate(K.TIERS)])


def language_tone_words(postings: DataFrame) -> DataFrame:
    """Words counted with tone, and shapes that several tones split."""
    return postings.groupBy("glottocode").agg(
        F.sum(F.greatest(F.lit(1), F.col("tones"))).alias("words"),
        F.count_if(F.col("tones") > 1).alias("multi_tone_shapes"))


def shape_tone_splits(postings: DataFrame) -> DataFrame:
    """Per shape: languages where tone splits it, and the words that makes."""
    return postings.where("tones > 1").groupBy("shape").agg(
        F.count(F.lit(1)).alias("languages"), F.sum("tones").alias("words"))


def language_grid(postings: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every language's own onset by vowel counts, with a 0-4 step of its maximum."""
    by = ["glottocode", "onset_class", "nucleus_bucket"]
    cells = postings.join(shapes.select("shape", *by[1:]), "shape").groupBy(*by).agg(F.count(F.lit(1)).alias("shapes"))
    top = F.max("shapes").over(Window.partitionBy("glottocode"))
    return cells.withColumn("step", F.least(F.lit(4), F.floor(4 * F.col("shapes") / top)).cast("int"))


def shape_spread_elsewhere(postings: DataFrame, languages: DataFrame) -> DataFrame:
    """Per (language, shape): other languages and other families that share it.

    The languages of a shape are never paired up: totals per shape, and whether
    the own family is among them, give both counts."""
    own = languages.select("glottocode", "family")
    used = postings.select("shape", "glottocode").distinct().join(own, "glottocode").join(
        family_or_self(languages), "glottocode")
    per_family = used.groupBy("shape", "fam").agg(F.count(F.lit(1)).alias("n"))
    totals = per_family.groupBy("shape").agg(F.sum("n").alias("langs"), F.count(F.lit(1)).alias("fams"))
    # a language always is one of its own family-or-self group, so that group goes
    return used.join(totals, "shape").select(
        "glottocode", "shape", (F.col("langs") - 1).alias("other_languages"), (F.col("fams") - 1).alias("other_families"))


def hidden_by_filter(postings: DataFrame, tier: str = "generated") -> DataFrame:
    """Languages with any form of a tier that a filter would hide."""
    return postings.where(F.col("tier_rank") == K.TIERS.index(tier)).agg(
        F.count_distinct("glottocode").alias("languages"))


def catalog_summary(languages: DataFrame, forms: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of totals, languages by best tier included."""
    best = forms.groupBy("glottocode").agg(F.min("tier_rank").alias("best"), F.count(F.lit(1)).alias("forms"))
    langs = languages.join(best, "glottocode", "left")
    out = langs.agg(
        F.count(F.lit(1)).alias("languages"), F.count_distinct(F.nullif(F.col("family"), F.lit(""))).alias("families"),
        F.coalesce(F.sum("forms"), F.lit(0)).alias("postings"),
        *[F.count_if(F.col("best") == i).alias(t) for i, t in enumerate(K.TIERS)],
        F.count_if(F.col("best").isNull()).alias("zero_form"),
        F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("unmapped"))
    return out.withColumns({
        "shapes": forms.agg(F.count_distinct("shape").alias("n")).scalar(),
        "sources": sources.agg(F.count_distinct("id").alias("n")).scalar()})


def cross_language_shapes(postings: DataFrame, top: int | None = None) -> DataFrame:
    """Shapes of two or more languages, widest first (ties by shape)."""
    out = postings.groupBy("shape").agg(F.count(F.lit(1)).alias("languages")).where("languages > 1")
    return out.orderBy(F.desc("languages"), "shape").limit(top) if top else out


def rank_shapes(shapes: DataFrame, postings: DataFrame, languages: DataFrame) -> DataFrame:
    """Shapes of every grid cell by families, then languages; one-language shapes are ``rare``."""
    by = ["onset_class", "nucleus_bucket"]
    spread = family_spread(postings, languages, ["shape"]).select("shape", "languages", "families")
    order = [F.desc("families"), F.desc("languages"), F.asc("shape")]
    return rank_within(spread.join(shapes.select("shape", *by), "shape"), by, order).withColumn(
        "rare", F.col("languages") == 1)


def top_meanings(summary: DataFrame, sort: str = "reach", count_by: str = "families", limit: int | None = None) -> DataFrame:
    """Meanings by reach, or only those beyond chance by their excess (ties by key); the first ``limit`` if given."""
    reach = F.col("fam_count" if count_by == "families" else "lang_count")
    if sort == "beyond":
        out = summary.where("beyond > 0").orderBy(F.desc("gap"), reach.desc(), "ckey")
    else:
        out = summary.orderBy(reach.desc(), "shape_count", "ckey")
    return out.limit(limit) if limit else out


def top_shape(postings: DataFrame) -> DataFrame:
    """The shape of most languages (ties by shape), be it one."""
    return postings.groupBy("shape").agg(F.count(F.lit(1)).alias("languages")).orderBy(F.desc("languages"), "shape").limit(1)


def language_shapes(postings: DataFrame, shapes: DataFrame, languages: DataFrame, glosses: DataFrame,
                    language: str, limit: int | None = None) -> DataFrame:
    """One language's shapes: in sound order where meanings are known, else the widest shared first."""
    mine = postings.where(F.col("glottocode") == language)
    spread = shape_spread_elsewhere(postings.join(mine.select("shape"), "shape", "left_semi"), languages).where(
        F.col("glottocode") == language)
    known = glosses.where((F.col("glottocode") == language)).agg((F.count(F.lit(1)) > 0).alias("k")).scalar()
    rank = ST.ordinal(F.col("onset_class"), K.ONSET_ORDER)
    out = mine.join(spread.drop("glottocode"), "shape").join(shapes.select("shape", "onset_class"), "shape")
    out = out.orderBy(F.when(~known, -F.col("other_families")), F.when(~known, -F.col("other_languages")), rank, "shape")
    return out.limit(limit) if limit else out


def gloss_preview(language_glosses: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` glosses of every (language, shape), and how many more there are.

    Ranked in parts of a group first, of which ``n`` rows each are left for the group's own rank."""
    by = ["glottocode", "shape"]
    part = F.pmod(F.xxhash64("gloss"), F.lit(64))
    def rank(*keys):
        return F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "gloss"))
    few = language_glosses.withColumn("_p", part).withColumn("_r", rank(*by, "_p")).where(F.col("_r") <= n)
    first = few.withColumn("_r", rank(*by)).where(F.col("_r") <= n)
    shown = first.groupBy(*by).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "gloss"))), lambda x: x["gloss"]), ", ").alias("preview"))
    total = language_glosses.groupBy(*by).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("more"))
    return shown.join(total, by)


def sources_listing(sources: DataFrame, by: str = "license") -> DataFrame:
    """Sources by licence (for reading) or by tier (for the index)."""
    key = F.col("license") if by == "license" else ST.ordinal(F.col("tier"), K.TIERS)
    return sources.orderBy(key, "id")


def compare_forms(forms: DataFrame, languages: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Chosen forms side by side: one row per attribute and form; no similarity score."""
    wanted = F.struct("glottocode", "shape").isin([F.struct(F.lit(g), F.lit(s)) for g, s in keys])
    rows = forms.where(wanted).join(languages.select("glottocode", "name"), "glottocode")
    attributes = {
        "tones": F.array_join("tones", " "), "language": F.col("name"), "tier": ST.name_at(F.col("tier_rank"), K.TIERS),
        "openness": ST.name_at(F.col("cc_rank"), K.CONFIDENCES),
        "review": F.when(F.col("under_review"), "under review").otherwise(""),
        "sources": F.array_join("sources", ", "),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in attributes.items()]))
    return rows.select("glottocode", "shape", pairs.alias("x")).select("glottocode", "shape", "x.attribute", "x.value")


def convergence(entries: DataFrame, languages: DataFrame, bands: DataFrame | None = None, fdr: float = K.FDR) -> DataFrame:
    """Shapes of every meaning by families, then languages, with tier composition and chance band."""
    by = ["ckey", "shape"]
    best = language_best(entries, by).join(languages.select("glottocode", "family"), "glottocode")
    tiers = [F.count_if(F.col("tier_rank") == i).alias(t) for i, t in enumerate(K.TIERS)]
    return convergence_of(best.groupBy(*by, "family").agg(F.count(F.lit(1)).alias("languages"), *tiers), bands, fdr)


def convergence_of(per_family: DataFrame, bands: DataFrame | None = None, fdr: float = K.FDR) -> DataFrame:
    """``convergence`` of the languages and tiers of each meaning, shape and family."""
    by = ["ckey", "shape"]
    out = per_family.groupBy(*by).agg(
        F.sum("languages").alias("languages"), F.count_if(F.col("family") != "").alias("families"),
        *[F.sum(t).alias(t) for t in K.TIERS])
    out = rank_within(out, ["ckey"], [F.desc("families"), F.desc("languages"), F.asc("shape")])
    if bands is None:
        return out
    b = bands.select(*by, "lo", "hi", "q").withColumn("beyond", F.col("q") <= fdr)
    return out.join(b, by, "left")
