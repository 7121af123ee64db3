"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2^22 places make all signature coordinates: the first
scatters a text's shingles, the second is read at circularly shifted places, so the
coordinates of one shingle are one contiguous slice of a table, and a signature is the
minimum of such slices. Bands of coordinates give the candidates, as many as the threshold
needs for a link just at it to be missed with a probability below 3e-7 (32 bands of 6 at
0.85, 50 of 6 at 0.80). Where many different texts
share buckets, one bit of each of 2048 coordinates is a sketch by which pairs below the
threshold are passed over (a link is lost with a probability below 1e-6). Every link is
confirmed on the full sets.

No pairs inside a group. Texts with equal sets are one class from the start. In a bucket each
class is first compared with one of them only, drawn anew for each bucket, so that groups of
near copies soon hang together; a bucket whose classes are then in one component is
done. In the others, what is outside the largest component is compared with the
rest, so no link between different texts is lost. Hot buckets and
components are held by joins that Spark can split, over written tables.

Shingles: A-Z lower-cased, words between ASCII white space, distinct runs of five words;
with fewer words the whole sequence is the one shingle. Shingles and sets are compared by
64-bit hashes of their words, classes by SHA-256 of the set.

Defined cases: null or wordless texts have the empty set and are linked with nothing (their
component is their own id). Null ids sort last. Repeated rows are in one component. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.llm.graph import components
from lexshape.llm.rows import text_sha, without
from lexshape.session import settle

SHINGLE = 5
ROWS, BANDS = 6, 64         # the most coordinates a band has, and the most bands as long as fewer coordinates would do
MISSED = 3e-7               # of the links at the threshold
SKETCH = 2048               # coordinates with one bit each, in 64-bit words
SIGMAS = 5.3                # a link whose sketches differ by more standard deviations than this is not looked at
UNIVERSE_BITS = 22
SEED = 20240229
MASK = (1 << 64) - 1


def banding(percent: int) -> tuple[int, int]:
    """Bands, and coordinates of each, by which fewer than ``MISSED`` of the links at the threshold share no band."""
    for rows in range(ROWS, 0, -1):
        apart = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log(apart)) if apart else 1
        if bands <= BANDS or rows == 1:
            return bands, rows


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Circulant:
    """Shingle sets and signatures; one instance per Python worker."""

    def __init__(self):
        if not os.environ.get("PYTHONHASHSEED", "").isdigit():      # Spark gives all its Python workers one seed
            raise RuntimeError("word hashes differ between Python workers: PYTHONHASHSEED is not fixed")
        rng = np.random.default_rng(SEED)
        size = 1 << UNIVERSE_BITS
        self.first = rng.permutation(size).astype(np.uint32)
        second = rng.permutation(size).astype(np.uint32)
        self.second = np.concatenate([second, second[:SKETCH - 1]])
        self.factors = rng.integers(1, MASK, SHINGLE, np.uint64) | np.uint64(1)
        self.band = rng.integers(1, MASK, SKETCH, np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, MASK, SKETCH, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a text as sorted hashes."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        h = mixed(np.fromiter(map(hash, words), np.int64, n).view(np.uint64))
        if n < SHINGLE:
            return mixed((h * self.factors[:n]).sum(keepdims=True) + np.uint64(n)) if n else h
        last = n - SHINGLE + 1
        total = h[:last] * self.factors[0]
        for j in range(1, SHINGLE):
            total += h[j:j + last] * self.factors[j]
        total = np.sort(mixed(total))
        return total[np.append(True, total[1:] != total[:-1])]

    def coordinates(self, shingles: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` signature coordinates: least of the slices of the second permutation, read in parts of 2 MB."""
        places = self.first[shingles >> np.uint64(64 - UNIVERSE_BITS)]
        shifted = np.lib.stride_tricks.sliding_window_view(self.second, n)
        low, rows = None, max(1, (1 << 19) // n)
        for a in range(0, len(places), rows):
            part = shifted[places[a:a + rows]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low

    def keys(self, shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
        values = self.coordinates(shingles, bands * rows).astype(np.uint64) * self.band[:bands * rows]
        return mixed(values.reshape(bands, rows).sum(axis=1) + self.salt[:bands]).view(np.int64)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        low = self.coordinates(shingles, SKETCH)
        bits = np.bitwise_xor.reduce(np.stack([low >> np.uint32(s) for s in range(0, UNIVERSE_BITS, 2)]), axis=0) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8)).view(np.int64)


_worker: list = []


def circulant() -> Circulant:
    if not _worker:
        _worker.append(Circulant())
    return _worker[0]


def signatures(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha of the text, n_shingles, set digest, keys of the bands for a threshold) of every row."""
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("sha", T.BinaryType()),
                        T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                        T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow, (n, rows) = to_arrow_schema(out), banding(percent)

    def run(batches):
        c = circulant()
        for batch in batches:
            sha, size, digest, bands = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                found = c.shingles(text)
                sha.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest())
                size.append(len(found))
                digest.append(hashlib.sha256(found.tobytes()).digest())
                bands.append(c.keys(found, n, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(arrow.field("doc_id").type), pa.array(sha, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(digest, pa.binary()), pa.array(bands, arrow.field("bands").type)], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, items): full shingle sets of (node, text) rows."""
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        c = circulant()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [c.shingles(t.as_py()).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, arrow.field("items").type)], schema=arrow)

    return texts.select("node", "text").mapInArrow(run, out)


def sketches(sets: DataFrame) -> DataFrame:
    """(node, n, sketch) of (node, items) rows."""
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches):
        c = circulant()
        for batch in batches:
            made = [x.values.to_numpy().view(np.uint64) for x in batch.column("items")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, made), pa.int64()), pa.array(map(c.sketch, made), arrow.field("sketch").type)], schema=arrow)

    return sets.select("node", "items").mapInArrow(run, out)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    common = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    both = F.size("a_items") + F.size("b_items")
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .withColumn("__common", common).where(F.col("__common") * 100 >= (both - F.col("__common")) * percent).select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, sha (of its text), n_shingles, component_id, root (of the component; null for the empty set)."""
    sig = settle(signatures(docs, percent, id_col, text_col))
    classes = settle(sig.where("n_shingles > 0").groupBy("digest").agg(
        F.min(F.struct("doc_id", "sha")).alias("rep"), F.min("doc_id").alias("id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    hubs = settle(keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key"), "node")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub.node"))
    hubs = hubs.select("key", F.col("node").alias("hub"))
    members = settle(keyed.join(hubs, "key"))

    involved = members.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = involved.select("node", F.col("rep.doc_id").alias("__id"), F.col("rep.sha").alias("__sha")).join(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == text_sha()))
    sets = settle(shingle_sets(texts))

    # each class with one class of each of its buckets, drawn anew for every bucket
    first = members.where("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    roots = components(confirmed(first, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("component", "root")

    # buckets of several components: the classes outside the largest one with all others there
    placed = settle(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "node", "root"))
    held = settle(placed.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key")
                  .agg(F.max_by("root", F.struct("k", "root")).alias("major"), F.count("*").alias("parts")).where("parts > 1").select("key", "major"))
    opened = settle(placed.join(held, "key").select("key", "node", "root", (F.col("root") != F.col("major")).alias("minor")))
    about = settle(sketches(sets.join(opened.select("node").distinct(), "node", "left_semi")))
    rows = opened.join(about, "node").join(classes.select("node", "bands"), "node")
    left, right = rows.where("minor").alias("l"), rows.alias("r")
    differ = (100 - percent) / 200                    # of the bits at the threshold
    most = int(SKETCH * differ + SIGMAS * math.sqrt(SKETCH * differ * (1 - differ)))
    apart = sum((F.bit_count(F.col("l.sketch")[i].bitwiseXOR(F.col("r.sketch")[i])) for i in range(1, SKETCH // 64)),
                F.bit_count(F.col("l.sketch")[0].bitwiseXOR(F.col("r.sketch")[0])))
    shared = F.zip_with("l.bands", "r.bands", lambda x, y: x == y)
    near = ((F.col("l.root") != F.col("r.root")) & (~F.col("r.minor") | (F.col("l.node") < F.col("r.node")))
            & (F.col("l.n") * 100 >= F.col("r.n") * percent) & (F.col("r.n") * 100 >= F.col("l.n") * percent) & (apart <= most)
            & (F.element_at("l.bands", F.array_position(shared, True).cast("int")) == F.col("l.key")))      # once, in their first bucket
    more = settle(left.join(right, (F.col("l.key") == F.col("r.key")) & near).select(
        F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"), F.least("l.root", "r.root").alias("u"), F.greatest("l.root", "r.root").alias("v")).distinct())
    linked = confirmed(more, sets, percent).join(more, ["a", "b"]).select("u", "v").distinct()
    merged = components(linked)

    of_class = settle(classes.select("digest", "node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                      .join(merged.select(F.col("node").alias("root"), F.col("component")), "root", "left")
                      .select("digest", "id", F.coalesce("component", "root").alias("root")))
    smallest = settle(of_class.groupBy("root").agg(F.min("id").alias("component_id")))
    named = settle(of_class.join(smallest, "root").select("digest", "component_id", "root"))
    linked_rows = sig.where("n_shingles > 0").select("doc_id", "sha", "n_shingles", "digest").join(named, "digest")
    alone = sig.where("n_shingles = 0").select("doc_id", "sha", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return linked_rows.select("doc_id", "sha", "n_shingles", "component_id", "root").unionByName(alone)


def near_decisions(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the smallest id of its component) of every row."""
    return near_duplicates(docs, **kw).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each component (that with the smallest id), all columns as they were."""
    rows = settle(near_duplicates(docs, **kw).where("root is not null").select("doc_id", "sha", "root"))
    first = settle(rows.groupBy("root").agg(F.min(F.struct("doc_id", "sha")).alias("first")))
    placed = rows.join(first, "root")
    again = rows.groupBy("doc_id", "sha").count().where("count > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    return without(docs, settle(placed.where(~stays).select("doc_id", "sha")), again)
