"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer
name from a sort; adjacent names are then paired and the pairs named the same way,
level by level, until each document has a single name. Names are injective at every
level (equal name <=> equal content), so no hash decides about equality: the hash
only deals rows out to partitions and orders them, the bytes themselves are compared.

Skew: the sort deals rows by (hash, document), so a block that a third of all
documents share is spread over many partitions; where a block continues in the next
partition, its first place gives the name. What is gathered about those borders is two
rows a partition.

Defined cases: a null text counts as empty (one empty block). Null ids sort below all
others. Rows that repeat both id and text all count in ``group_size``, and exactly one
of them is kept. An empty table gives an empty result. Only the id and text columns
are read; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lexshape.llm.rows import text_sha, without
from lexshape.session import settle

BLOCK_BYTES = 16384


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, n_blocks, pos, block): every document cut into fixed-size blocks."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    cut = docs.select(F.col(id_col).alias("doc_id"), text_sha(text_col).alias("sha"), body.alias("body"))
    n = F.greatest(F.ceil(F.octet_length("body") / F.lit(block_bytes)), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                        lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    return (cut.withColumn("n_blocks", n).withColumn("parts", parts)
            .select("doc_id", "sha", "n_blocks", F.posexplode("parts").alias("pos", "block")))


def _ranked(schema: pa.Schema):
    """Dense rank of the blocks within a sorted partition, and its first and last block.

    Yields one row for each block place (``edge`` null) and one for each distinct block
    in the first and the last run of a hash (``edge`` holds the block)."""
    def run(batches):
        pid = TaskContext.get().partitionId()
        rank, last, first_hash, last_hash, tail = -1, None, None, None, []

        def edges(rows):
            n = len(rows)
            cols = {"pid": pa.array([pid] * n, pa.int32()), "rank": pa.array([r for r, _ in rows], pa.int64()),
                    "edge": pa.array([b for _, b in rows], pa.binary())}
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, hashes = batch.column("block"), batch.column("hash")
            fresh = pa.concat_arrays([pa.array([last is None or block[0].as_py() != last]),
                                      pc.not_equal(block.slice(1), block.slice(0, len(block) - 1)).cast(pa.bool_())])
            ranks = pc.add(pc.cumulative_sum(fresh.cast(pa.int64())), rank)
            for i in pc.indices_nonzero(fresh).to_pylist():
                h = hashes[i].as_py()
                if first_hash is None:
                    first_hash = h
                if h != last_hash:
                    if last_hash == first_hash and tail:
                        yield edges(tail)
                    tail, last_hash = [], h
                tail.append((ranks[i].as_py(), block[i].as_py()))
            rank, last = ranks[-1].as_py(), block[-1].as_py()
            n = batch.num_rows
            cols = {"pid": pa.array([pid] * n, pa.int32()), "rank": ranks}
            yield pa.RecordBatch.from_arrays(
                [cols[f.name] if f.name in cols else pa.nulls(n, f.type) if f.name == "edge" else batch.column(f.name).cast(f.type)
                 for f in schema], schema=schema)
        if tail:
            yield edges(tail)
    return run


def name_blocks(cut: DataFrame) -> DataFrame:
    """Integer names of all blocks: (doc_id, sha, n_blocks, pos, copies, name)."""
    dealt = (cut.withColumn("hash", F.xxhash64("block"))
             .repartitionByRange("hash", "doc_id", "sha", "pos")
             .sortWithinPartitions("hash", "block", "doc_id", "sha", "pos"))
    out = T.StructType([T.StructField(f.name, f.dataType) for f in cut.schema if f.name != "block"]
                       + [T.StructField("pid", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("edge", T.BinaryType())])
    ranked = settle(dealt.mapInArrow(_ranked(to_arrow_schema(out)), out))
    places = ranked.where("edge is null")
    start = (places.groupBy("pid").agg((F.max("rank") + 1).alias("n"))     # one row a partition
             .select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("start")))
    edge = ranked.where("edge is not null").select("pid", "rank", "edge").distinct()
    canon = edge.groupBy("edge").agg(F.min(F.struct("pid", "rank")).alias("c"))
    moved = (edge.join(canon, "edge").where("pid != c.pid or rank != c.rank")
             .select("pid", "rank", F.col("c.pid").alias("to_pid"), F.col("c.rank").alias("to_rank")))
    merged = places.groupBy("doc_id", "sha", "n_blocks", "pos", "pid", "rank").agg(F.count("*").alias("copies"))
    return (merged.join(moved, ["pid", "rank"], "left")
            .withColumn("pid", F.coalesce("to_pid", "pid")).withColumn("rank", F.coalesce("to_rank", "rank"))
            .join(start, "pid")
            .select("doc_id", "sha", "n_blocks", "pos", "copies", (F.col("start") + F.col("rank")).alias("name")))


def name_pairs(names: DataFrame) -> DataFrame:
    """One level up: names of adjacent pairs (a last name without a neighbour pairs with -1)."""
    half = F.expr("pos div 2").cast("int")
    pairs = settle(names.groupBy("doc_id", "sha", half.alias("pos")).agg(
        F.max("copies").alias("copies"),
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
    table = settle(pairs.select("left", "right").distinct().repartitionByRange("left", "right")
                   .sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()))
    return settle(pairs.join(table, ["left", "right"]).select("doc_id", "sha", "pos", "copies", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, copies, level, name): the collision-free identity (level, name) of each distinct (id, text)."""
    named = settle(name_blocks(blocks(docs, block_bytes, id_col, text_col)))
    done = named.where("n_blocks = 1").select("doc_id", "sha", "copies", F.lit(0).alias("level"), "name")
    most = named.agg(F.max("n_blocks")).first()[0] or 1
    level, names = 0, named.where("n_blocks > 1").drop("n_blocks")
    while 1 << level < most:
        level, names = level + 1, name_pairs(names)
    return done if not level else done.unionByName(names.select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): doc_id, sha, copies, keep_id (largest id of the equal texts), group_size."""
    ident = settle(identities(docs, block_bytes, id_col, text_col))
    groups = ident.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return ident.join(groups, ["level", "name"]).select("doc_id", "sha", "copies", "keep_id", "group_size")


def exact_decisions(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = exact_groups(docs, **kw).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one row of each set of equal texts, all columns as they were."""
    groups = settle(exact_groups(docs, **kw))
    return without(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))), groups.where("copies > 1"))
