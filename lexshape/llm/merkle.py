"""Merkle manifest of a dataset: a tree of fanout 8 for each group, proofs by a butterfly exchange.

A leaf is the SHA-256 of a row's fields. In each group (a language) the leaves stand in the order
of their ids; every 8 neighbours become the hash of their digests until one node remains, and
the groups' roots, in the order of their names, become the root of the manifest the same way.

Leaves are cut into aligned blocks of ``BLOCK`` = 8^k, the partitions of the exchange. A task builds the
tree of its block. Then the blocks' roots are exchanged round by round: in round r the up to 8
blocks whose numbers differ only in the r-th octal digit swap the nodes they hold, so each
learns the siblings of its own node and hashes the common parent itself. All blocks
below a node hold it after its round (the same hash, made redundantly), hence every block has its
upper proof at the end and nothing is sent down the tree. Where the last node of a level stands for
fewer blocks than the others, its blocks serve the partners that are missing, in turn.
The groups' roots pass through the same two steps as leaves of a last tree.

Hot groups: rows are cut into even ranges of (group, id), so a group of any size is spread over many
blocks; a round meets at most 8 rows at a key. Equal rows are parted by a row number.

Defined cases: null fields are "-"; a null id comes first in its group, a null group is a group of
its own and comes first. Rows that repeat an id stand side by side, in the order of their leaves. A lone
leaf is its group's root and has an empty proof of its own (SHA-256 of nothing, where its group is alone
as well). An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexshape.session import settle

FANOUT = 8
BLOCK = FANOUT ** 4          # leaves of a block
STAND_INS = 4096             # places that one row takes of a partner that is missing, at a time
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: its length in UTF-8 bytes, a colon, and its value; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in the group from 0 on, and ``size``, the rows of the group.

    Even ranges of (group, order), written once and numbered each on its own, then shifted by the rows before them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = settle(rows.withColumn("__row", F.monotonically_increasing_id()))      # parts equal rows for good
    keys = [F.col(c).asc_nulls_first() for c in [group, *order, "__row"]]
    cut = settle(keyed.repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id()))
    counts = settle(cut.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n")))       # a group has at most one row a range
    ranges = Window.partitionBy(group).orderBy("__range")
    before = F.coalesce(F.sum("__n").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col(group).alias("__group"), F.col("__range").alias("__of"), before.alias("__before"), F.sum("__n").over(
        ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"))
    own = F.row_number().over(Window.partitionBy("__range", group).orderBy(*keys))
    return (cut.withColumn("__own", own)
            .join(shifts, (F.col("__range") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
            .withColumn("at", F.col("__own") - 1 + F.col("__before"))
            .drop("__row", "__range", "__own", "__group", "__of", "__before"))


def block_tree(leaves: list[str], size: int, block: int = BLOCK) -> list[list[str]]:
    """The levels of a block's tree from its leaves to its root; ``size`` is that of the whole group."""
    levels, width = [leaves], min(size, block)
    while width > 1:
        below, width = levels[-1], -(-width // FANOUT)
        levels.append([hashlib.sha256("".join(below[a:a + FANOUT]).encode()).hexdigest() for a in range(0, len(below), FANOUT)])
    return levels


def block_roots(placed: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(group, block, blocks, node): the root of each block of ``leaf`` rows with ``at`` and ``size``; a block is one task's rows."""
    out = T.StructType([placed.schema[group], T.StructField("block", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("node", T.StringType())])
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        size = rows.column("size")[0].as_py()
        root = block_tree(rows.column("leaf").to_pylist(), size, block)[-1][0]
        return pa.Table.from_arrays([rows.column(group).slice(0, 1), pa.array([rows.column("at")[0].as_py() // block]),
                                     pa.array([-(-size // block)]), pa.array([root])], schema=arrow)

    return placed.select(group, "leaf", "at", "size", F.floor(F.col("at") / block).alias("__block")).groupBy(group, "__block").applyInArrow(run, out)


def butterfly(nodes: DataFrame, group: str) -> DataFrame:
    """(group, block, siblings, root) of (group, block, blocks, node): after the last round every block has the
    siblings of all nodes above it, in one text from the lowest level up, and the group's root."""
    state = settle(nodes.withColumn("siblings", F.lit("")))
    most = state.agg(F.max("blocks")).first()[0] or 0
    stride = 1
    while stride < most:
        state = settle(_round(state, group, stride))
        stride *= FANOUT
    return state.select(group, "block", "siblings", F.col("node").alias("root"))


def _round(state: DataFrame, group: str, stride: int) -> DataFrame:
    """One exchange: blocks of ``stride`` * 8 neighbours that are alike in all octal digits but the one of ``stride``."""
    s = F.lit(stride)
    node_at, low = F.floor(F.col("block") / s), F.col("block") % s
    last, held = F.floor((F.col("blocks") - 1) / s), (F.col("blocks") - 1) % s + 1          # the last node of the level, and its blocks
    # blocks of a short last node answer for the places it lacks; nobody waits for it where it is alone in its run
    short = (node_at == last) & (held < s) & (last % FANOUT > 0)
    step = held * STAND_INS
    served = state.withColumn("__from", F.explode(F.when(short, F.sequence(low, s - 1, step)).otherwise(F.array(low))))
    served = served.withColumn("__low", F.explode(F.when(short, F.sequence("__from", F.least(F.col("__from") + step - held, s - 1), held)).otherwise(F.array("__from"))))
    member = F.struct((node_at % FANOUT).alias("digit"), "node", F.when(F.col("__low") == low, F.col("block")).alias("block"), "blocks", "siblings")
    met = served.groupBy(group, F.floor(F.col("block") / (s * FANOUT)).alias("__run"), "__low").agg(F.sort_array(F.collect_list(member)).alias("run"))     # at most 8
    each = met.select(group, "run", F.explode(F.filter("run", lambda m: m["block"].isNotNull())).alias("own"))
    others = F.array_join(F.transform(F.filter("run", lambda m: m["digit"] != F.col("own.digit")), lambda m: m["node"]), "")
    parent = digest(F.array_join(F.transform("run", lambda m: m["node"]), ""))
    climbs = F.col("own.blocks") > stride                                                    # smaller groups are done
    return each.select(group, F.col("own.block").alias("block"), F.col("own.blocks").alias("blocks"), F.when(climbs, parent).otherwise(F.col("own.node")).alias("node"),
                       F.when(climbs, F.concat("own.siblings", others)).otherwise(F.col("own.siblings")).alias("siblings"))


def sibling_counts(place: int, size: int) -> list[int]:
    """How many siblings the node above a leaf has at each level of a tree over ``size`` leaves."""
    counts = []
    while size > 1:
        counts.append(min(FANOUT, size - place // FANOUT * FANOUT) - 1)
        place, size = place // FANOUT, -(-size // FANOUT)
    return counts


def steps_of(siblings: str, place: int, counts: list[int]) -> list[tuple[str, str]]:
    """Siblings in one text as (those before, those after) the own node, level by level; ``place`` is that on the lowest of them."""
    steps, at = [], 0
    for n in counts:
        own, end = at + 64 * (place % FANOUT), at + 64 * n
        steps.append((siblings[at:own], siblings[own:end]))
        at, place = end, place // FANOUT
    return steps


def steps_in(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The same for the ``i``-th leaf of a block, from the levels of its tree."""
    steps = []
    for level in levels[:-1]:
        run = i // FANOUT * FANOUT
        steps.append(("".join(level[run:i]), "".join(level[i + 1:run + FANOUT])))
        i //= FANOUT
    return steps


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a digest leads to between its siblings."""
    for before, after in steps:
        node = hashlib.sha256((before + node + after).encode()).hexdigest()
    return node


def _each_block(placed: DataFrame, upper: DataFrame, group: str, block: int, out: T.StructType, make) -> DataFrame:
    """Rows made by ``make(rows, upper row, leaf number in its block -> steps)`` from each block and what the exchange left to it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in to_arrow_schema(out)], schema=to_arrow_schema(out))
        rows, over = left.sort_by("at"), right.to_pylist()[0]
        first, size = rows.column("at")[0].as_py(), rows.column("size")[0].as_py()
        levels = block_tree(rows.column("leaf").to_pylist(), size, block)
        lower = len(levels) - 1
        above = steps_of(over["siblings"], first // FANOUT ** lower, sibling_counts(first, size)[lower:])
        columns = make(rows, over, lambda i: steps_in(levels, i) + above)
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, to_arrow_schema(out))], schema=to_arrow_schema(out))

    blocks = placed.withColumn("block", F.floor(F.col("at") / block)).groupBy(group, "block")
    return blocks.cogroup(upper.groupBy(group, "block")).applyInArrow(run, out)


def _top(subroots: DataFrame, block: int) -> DataFrame:
    """(group, subroot, place, places, above, root) of (group, root) rows: the last tree, over the groups' roots."""
    tops = settle(in_order(subroots.select(F.lit(0).alias("all"), "group", F.col("root").alias("leaf")), "all", ["group"]))
    out = T.StructType([T.StructField("group", T.StringType()), T.StructField("subroot", T.StringType()), T.StructField("place", T.LongType()),
                        T.StructField("places", T.LongType()), T.StructField("above", T.StringType()), T.StructField("root", T.StringType())])

    def make(rows, over, steps):
        text = ["".join(a + b for a, b in steps(i)) for i in range(rows.num_rows)]
        return [rows.column("group"), rows.column("leaf"), rows.column("at"), rows.column("size"), text, [over["root"]] * rows.num_rows]

    return settle(_each_block(tops, butterfly(block_roots(tops, "all", block), "all"), "all", block, out, make))


def manifest(docs: DataFrame, claimed: Column | None = None, fields: tuple = FIELDS, group: str = "lang", id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``claimed`` is the text that a row is said to have where it is verified (its own by default): the leaf made of it
    is folded with the siblings of the manifest and must lead to the manifest's root."""
    said = [claimed if c == text_col and claimed is not None else F.col(c) for c in fields]
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("group"), leaf(*map(F.col, fields)).alias("leaf"), leaf(*said).alias("claim"))
    placed = settle(in_order(leaves, "group", ["doc_id", "leaf"]))
    upper = butterfly(block_roots(placed, "group", block), "group")
    top = _top(upper.where("block = 0").select("group", "root"), block)
    over = upper.drop("root").join(top.withColumnRenamed("group", "__of"), F.col("group").eqNullSafe(F.col("__of"))).drop("__of")
    digests = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    out = T.StructType([docs.select(F.col(id_col).alias("doc_id")).schema[0], *(T.StructField(c, T.StringType()) for c in digests)])

    def make(rows, over, steps):
        last = steps_of(over["above"], over["place"], sibling_counts(over["place"], over["places"]))
        proof, folded = [], []
        for i, claim in enumerate(rows.column("claim").to_pylist()):
            path = steps(i) + last
            proof.append(hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest())
            folded.append(fold(claim, path))
        same = lambda c: [over[c]] * rows.num_rows
        return [rows.column("doc_id"), rows.column("leaf"), same("subroot"), same("root"), proof, folded]

    return _each_block(placed, over, "group", block, out, make).withColumn("verified", F.col("folded_root") == F.col("root"))
