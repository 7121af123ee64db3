"""Key schemes: a canonicalizer with a version, and what a change of scheme does to keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape import constants as K
from lexshape.functions import canon as C
from lexshape.operators import rows


@dataclass(frozen=True)
class Scheme:
    """``canonicalizer`` adds segmental, tone and segments to a DataFrame of transcriptions; none is the library's own."""
    version: str
    canonicalizer: Callable[[DataFrame], DataFrame] | None = None

    def keys(self, words: DataFrame) -> DataFrame:
        """``words`` (ipa, segmented) with segmental, tone and segments."""
        return rows.canonicalize(words, canonicalizer=self.canonicalizer)


TONE_BLIND = Scheme(K.SCHEME_VERSION)


def length_blind(words: DataFrame) -> DataFrame:
    """Keys of the library's scheme without length marks and without repeated neighbours."""
    loose = rows.canonicalize(words).withColumn("segmental", C.loose_key(F.col("segmental")))
    short = F.transform(C.segment_array(F.col("segments")), lambda s: F.replace(s, F.lit("ː"), F.lit("")))
    # an array column of its own, so that a segment can look at the one before it
    loose = loose.withColumn("_short", short)
    return loose.withColumn("segments", F.array_join(F.filter("_short", lambda s, i: (i == 0) | (s != F.get("_short", i - 1))), " ")).drop("_short")


LENGTH_BLIND = Scheme("length-blind-1", length_blind)


def key_changes(words: DataFrame, old: Scheme, new: Scheme) -> DataFrame:
    """(old_key, new_key, words): how the keys of one scheme map to those of another, over all (ipa, segmented) rows.

    Transcriptions are collapsed first, so a frequent word is judged once and a hot key is a count before it is shuffled."""
    distinct = words.groupBy("ipa", "segmented").agg(F.count(F.lit(1)).alias("n"))
    was = old.keys(distinct).select("ipa", "segmented", "n", F.col("segmental").alias("old_key"))
    return new.keys(was).groupBy("old_key", F.col("segmental").alias("new_key")).agg(F.sum("n").alias("words"))


def merged_keys(changes: DataFrame) -> DataFrame:
    """(new_key, old_keys): keys of the new scheme that several old ones fall into."""
    return changes.groupBy("new_key").agg(F.count_distinct("old_key").alias("old_keys")).where("old_keys > 1")
