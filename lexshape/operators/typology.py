"""Typology: syllable classes and sound inventories per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.operators.rows import segment_classes


def syllable_structure(languages: DataFrame, values: DataFrame, parameter: str = K.SYLLABLE_PARAMETER) -> DataFrame:
    """Syllable class per language code; codes with two different values are left out."""
    codes = F.create_map(*[F.lit(x) for kv in K.SYLLABLE_CODES.items() for x in kv])
    known = values.where((F.col("Parameter_ID") == parameter) & F.col("Value").isin(*K.SYLLABLE_CODES))
    langs = languages.where("coalesce(Glottocode, '') <> ''").select(
        F.col("ID").alias("Language_ID"), F.col("Glottocode").alias("glottocode"))
    seen = known.join(langs, "Language_ID").select("glottocode", codes[F.col("Value")].alias("c")).distinct()
    return seen.groupBy("glottocode").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("syllable_structure")).where("n = 1").drop("n")


def inventories(parameters: DataFrame, values: DataFrame) -> DataFrame:
    """Onset classes and vowel buckets of every inventory of a language, unioned.

    The segment rules run on distinct segments; both lists must be non-empty."""
    klass = parameters.select(F.col("ID").alias("Parameter_ID"), F.col("SegmentClass").alias("segment_class"))
    used = values.join(klass, "Parameter_ID", "left").select(
        F.col("Language_ID").alias("glottocode"), F.col("Value").alias("value"),
        F.coalesce(F.col("segment_class"), F.lit("")).alias("segment_class")).distinct()
    per = used.join(segment_classes(used), ["value", "segment_class"])
    out = per.groupBy("glottocode").agg(
        F.array_sort(F.collect_set("onset")).alias("onsets"), F.array_sort(F.collect_set("nucleus")).alias("nuclei"))
    return out.where("size(onsets) > 0 and size(nuclei) > 0")


def attach_typology(languages: DataFrame, syllables: DataFrame, inventory: DataFrame) -> DataFrame:
    return (languages.join(syllables, "glottocode", "left").fillna("", ["syllable_structure"])
            .join(inventory, "glottocode", "left"))
