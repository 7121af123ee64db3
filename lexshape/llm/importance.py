"""Target-distribution importance resampling: array-scored weights, then a distributed quickselect.

A text's features are its runs of one and two words, hashed into ``BUCKETS`` buckets. Counts of the
buckets over all documents and over all target texts give a gain for each bucket (the log ratio of
the two smoothed shares, in thousandths); the gains are one array of fixed size that every task
reads by position. A document's weight is the mean gain of its features, its score the weight
with Gumbel noise from its id, so that the highest scores are a draw without replacement.

The draw needs the k-th key of (score falling, id rising). It is found on the written scores:
each round takes a few rows of the range still open as pivots, drawn anew by a hash, and counts
exactly what lies before, at and after each (three ways), which narrows the range to a share of
about one in the number of pivots. Only counts and pivots reach the driver. The rows up to the
k-th key, the winners, are then sorted alone, cut into ranges, and ranked.

Hot keys: bucket counts are summed in each task before the shuffle, so a common word is one row a
task. Keys end in a row number, so equal rows (or null ids) split like any others.

Defined cases: a null or wordless text has no features and weight 0. A null id sorts after all
others and its noise is that of an empty id. Rows that repeat an id are scored and drawn each; of equal scores
and ids the fewer features come first. Without drawn rows every rank is null. An empty corpus gives an empty result;
an empty target gives smoothed gains. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.session import settle

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
PIVOTS = 24              # of a round of the selection
PIECE = 1 << 18          # words of a text that are hashed at a time
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def feature_buckets(words: list[bytes], buckets: int = BUCKETS):
    """Arrays of the buckets of all single words and of all neighbouring pairs ("a b"), a bounded piece at a time."""
    for a in range(0, len(words), PIECE):
        part = words[a:a + PIECE + 1]
        single = list(map(zlib.crc32, part))
        opened = map(zlib.crc32, repeat(b" "), single)
        pairs = np.fromiter(map(zlib.crc32, part[1:], opened), np.int64)
        yield np.concatenate([np.array(single[:PIECE], np.int64), pairs]) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: an array of fixed size."""
    out = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for part in feature_buckets(words_of(text.as_py()), buckets):
                    total += np.bincount(part, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], schema=arrow)

    counts = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(text_col).mapInArrow(run, out).groupBy("bucket").agg(F.sum("n")).collect():     # at most one row a bucket
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: log of the target's share over the corpus's share, one added to each count, in floored thousandths."""
    buckets = len(corpus)
    whole_corpus, whole_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * whole_corpus / ((s + 1) * whole_target)))
                     for s, t in zip(map(float, corpus), map(float, target))], np.int64)


def gumbel(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Floored thousandths of Gumbel noise that the id decides."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score) of every row."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            sizes, weights = [], []
            for text in batch.column(1):
                n = total = 0
                for part in feature_buckets(words_of(text.as_py()), len(gain)):
                    n, total = n + len(part), total + int(gain[part].sum())
                sizes.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], schema=arrow)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
    return rows.withColumn("score", F.col("weight") + gumbel("doc_id", seed))


KEY = ("fallen", "id_missing", "doc_id", "n_features", "row")


def with_key(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``key``: score falling, id rising with nulls last, then features and a row number that parts equal rows."""
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = {"fallen": -F.col("score"), "id_missing": F.col("doc_id").isNull()}
    return rows.withColumn("key", F.struct(*[parts.get(c, F.col(c)).alias(c) for c in KEY]))


def _literal(key: Row, kinds: T.StructType) -> Column:
    return F.struct(*[F.lit(key[f.name]).cast(f.dataType).alias(f.name) for f in kinds])


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED) -> Column:
    """The k-th smallest ``key`` (from 1 on), as a literal; k is at most the number of rows."""
    kinds = keyed.schema["key"].dataType
    left = keyed.select("key")
    open_range, turn = left, 0
    while True:
        drawn = open_range.orderBy(F.xxhash64("key.row", F.lit(seed + turn)), "key").limit(pivots).orderBy("key").collect()
        marks = [_literal(r["key"], kinds) for r in drawn]
        beyond = reduce(lambda a, b: a + b, [F.when(F.col("key") > m, 1).otherwise(0) for m in marks])
        at_mark = reduce(lambda a, b: a | b, [F.col("key") == m for m in marks])
        counts = sorted(tuple(r) for r in open_range.groupBy(beyond.alias("b"), at_mark.alias("at")).count().collect())
        # in the order of the keys: what lies after ``b`` pivots and before the next, then that pivot itself
        for b, at, n in counts:
            if k <= n:
                break
            k -= n
        if at:
            return marks[b]
        if b > 0:
            open_range = open_range.where(F.col("key") > marks[b - 1])
        if b < len(marks):
            open_range = open_range.where(F.col("key") < marks[b])
        turn += 1


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, from 1 on in the order of ``key``: even ranges, each numbered and shifted by those before it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settle(rows.repartitionByRange(parts, "key").withColumn("__range", F.spark_partition_id()))
    before = cut.groupBy("__range").count().withColumn("__before", F.coalesce(
        F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))     # one row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy("key"))
    return cut.withColumn("__own", own).join(before.drop("count"), "__range").withColumn("rank", (F.col("__own") + F.col("__before")).cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; ``rank`` is null for rows that are not drawn.

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred (rounded down) are drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    keyed = with_key(scored(docs, gain, seed, id_col, text_col))
    fit = F.col("n_features") >= 2 * min_words - 1           # w words have w + (w - 1) features
    k = keyed.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return keyed.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = fit & (F.col("key") <= kth_key(keyed.where(fit), k))
    rest = keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(keyed.where(drawn)).select(*columns, "rank").unionByName(rest)
