"""Shape and meaning index over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions import wording as W
from lexshape.functions.unicode import fold, strip


def postings(forms: DataFrame) -> DataFrame:
    """Flat postings: which language has which shape, how trusted, how many tones."""
    return forms.select("shape", "glottocode", "tier_rank", "cc_rank", "under_review",
                        F.size("tones").alias("tones"))


def shape_features(forms: DataFrame) -> DataFrame:
    """Features of a shape, from its first form in language order, and its spread."""
    return forms.groupBy("shape").agg(
        F.min_by(F.struct("onset_class", "nucleus_bucket", "nucleus_type"), "glottocode").alias("f"),
        F.count(F.lit(1)).alias("languages")).select("shape", "f.*", "languages")


def form_counts(languages: DataFrame, forms: DataFrame) -> DataFrame:
    """Forms per language, zeros included."""
    n = forms.groupBy("glottocode").agg(F.count(F.lit(1)).alias("form_count"))
    return languages.select("glottocode").join(n, "glottocode", "left").fillna(0, ["form_count"])


def concept_entries(glosses: DataFrame, forms: DataFrame) -> DataFrame:
    """One row per (form, word, gloss) under its concept key; multiplicity is kept."""
    f = forms.select("glottocode", "shape", "tier_rank", "cc_rank", "under_review")
    word = ["glottocode", "shape", "tone"]
    first = glosses.groupBy(*word).agg(F.min("seq").alias("word_seq"))
    g = glosses.drop("tier_rank").withColumn("ckey", W.concept_key(F.col("concepticon_id"), F.col("gloss")))
    return g.join(first, word).join(f, ["glottocode", "shape"])


def build_concepts(entries: DataFrame) -> DataFrame:
    """Per concept: votes, languages and shapes."""
    return entries.groupBy("ckey").agg(
        F.count(F.lit(1)).alias("votes"), F.count_distinct("glottocode").alias("lang_count"),
        F.count_distinct("shape").alias("shape_count"))


def concept_labels(entries: DataFrame) -> DataFrame:
    """One label per concept: its commonest gloss, told apart where concepts collide.

    ``entries`` needs ckey, gloss, concepticon_id, concepticon_gloss and the order
    (glottocode, shape, word_seq, seq); or ``votes`` per row to start from counts."""
    n = F.sum("votes") if "votes" in entries.columns else F.count(F.lit(1))
    votes = entries.groupBy("ckey", strip(F.col("gloss")).alias("text")).agg(n.alias("n"))
    spelled = votes.groupBy("ckey", fold(F.col("text")).alias("fold")).agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "text")).alias("best"))
    commonest = spelled.groupBy("ckey").agg(
        F.max(F.struct("total", "fold", F.col("best.text").alias("text")))["text"].alias("gloss"))
    order = [c for c in ("glottocode", "shape", "word_seq", "seq") if c in entries.columns] or ["concepticon_gloss"]
    named = entries.groupBy("ckey").agg(
        F.min_by(F.struct("concepticon_id", "concepticon_gloss"), F.struct(*order)).alias("c")).select(
        "ckey", F.nullif(F.col("c.concepticon_id"), F.lit(0)).alias("cid"), F.col("c.concepticon_gloss").alias("cg"))
    base = commonest.join(named, "ckey").withColumn(
        "base", F.when(fold(F.col("cg")) == fold(F.col("gloss")), W.concept_word(F.col("cg"))).otherwise(F.col("gloss"))
    ).withColumn("fold", fold(F.col("base")))
    crowd = base.groupBy("fold").agg(F.count(F.lit(1)).alias("crowd"), F.count("cid").alias("linked"))
    by_id = F.concat(F.col("base"), F.lit(" ("), F.col("cid").cast("string"), F.lit(")"))
    unlinked = F.col("cid").isNull()
    labels = base.join(crowd, "fold").select(
        "ckey", "cid", "cg",
        F.when(unlinked, F.when(F.col("crowd") > 1, F.concat("base", F.lit(" (unlinked)"))).otherwise(F.col("base")))
        .when((F.col("linked") == 1) | (fold(F.col("cg")) == F.col("fold")), F.col("base"))
        .when(F.coalesce(F.col("cg"), F.lit("")) != "", W.concept_word(F.col("cg"))).otherwise(by_id).alias("label"))
    for _ in range(2):
        labels = _tell_apart(labels)
    return labels.select("ckey", "label")


def _tell_apart(labels: DataFrame) -> DataFrame:
    """One repair pass, all labels at once: in a group of equal labels the
    unlinked concepts are marked; only a group without any gets concept ids."""
    mine = labels.withColumn("fold", fold(F.col("label")))
    marked = F.col("label").endswith("(unlinked)")
    crowd = mine.groupBy("fold").agg(
        F.count(F.lit(1)).alias("crowd"), F.count_if(F.col("cid").isNull()).alias("unlinked")).where("crowd > 1")
    clash = F.col("crowd").isNotNull()
    return mine.join(crowd, "fold", "left").select(
        "ckey", "cid", "cg",
        F.when(clash & F.col("cid").isNull() & ~marked, F.concat("label", F.lit(" (unlinked)")))
        .when(clash & F.col("cid").isNotNull() & (F.col("unlinked") == 0),
              F.concat("label", F.lit(" ("), F.col("cid").cast("string"), F.lit(")")))
        .otherwise(F.col("label")).alias("label"))


def family_or_self(languages: DataFrame) -> DataFrame:
    """Language -> family, where a language without a family is one of its own."""
    own = F.concat(F.lit("lang:"), F.col("glottocode"))
    return languages.select("glottocode", F.coalesce(F.nullif(F.col("family"), F.lit("")), own).alias("fam"))


def concept_summary(entries: DataFrame, languages: DataFrame, labels: DataFrame,
                    bands: DataFrame | None = None, fdr: float = K.FDR) -> DataFrame:
    """Reach of every concept, and how many of its shapes are beyond chance."""
    used = entries.select("ckey", "glottocode").distinct().join(family_or_self(languages), "glottocode")
    reach = used.groupBy("ckey").agg(
        F.count(F.lit(1)).alias("lang_count"), F.count_distinct("fam").alias("fam_count"))
    shapes = entries.groupBy("ckey").agg(F.count_distinct("shape").alias("shape_count"))
    out = reach.join(shapes, "ckey").join(labels, "ckey")
    if bands is None:
        return out.withColumns({"beyond": F.lit(0), "gap": F.lit(0)})
    from lexshape.operators.baseline import beyond_chance
    return out.join(beyond_chance(bands, fdr), "ckey", "left").fillna(0, ["beyond", "gap"])


def language_glosses(glosses: DataFrame) -> DataFrame:
    """Per language and shape: the distinct glosses, each with its first ``seq``."""
    return glosses.groupBy("glottocode", "shape", "gloss").agg(F.min("seq").alias("seq"))
