"""Shards through fixed virtual slots.

A record's key is hashed to one of a few thousand slots. A slot that holds more than a
``PART`` of a shard (one key, or none, may be a third of all rows) is opened: its records are hashed
by key, text and place instead and so lie in all slots; the map says which slots are open. Bytes
are summed per slot, and a map from slot to shard, stored in versions, says where a slot
lives. Rebalancing edits the map: it moves as few slots as evens out the bytes, writes
the next version and never touches the hash. Adding a shard moves slots into it only.

The map and the sums per slot have a fixed number of rows, whatever the data; they are
the only things the driver sees and the only table that is broadcast.

Positions within a shard are counted in two steps (rows of a slot in a written part,
then totals over parts and slots), so neither a shard nor a slot is ever one task's group.

Defined cases: a null text has no bytes (size 1, CRC 0). Null keys share a slot, and so do rows that
repeat a key, unless it is open; each row gets a position of its own. An empty table
gives an empty result and an even map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexshape.session import settle

SLOTS = 4096
PART = 64                   # a slot with more than this part of an even shard is opened


def slot_of(*keys: str, slots: int = SLOTS):
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes per slot of (vslot, size) rows: a list of ``slots`` numbers."""
    sizes = [0] * slots
    for slot, size in rows.groupBy("vslot").agg(F.sum("size")).collect():    # at most `slots` rows
        sizes[slot] = size
    return sizes


def hot_slots(sizes: list[int], shards: int) -> list[int]:
    """Slots of more than a ``PART`` of an even shard: fewer than ``shards * PART``."""
    limit = sum(sizes) / (shards * PART)
    return [slot for slot, size in enumerate(sizes) if size > limit]


def open_slots(rows: DataFrame, opened: list[int], slots: int = SLOTS) -> DataFrame:
    """Deal the records of opened slots over all slots."""
    dealt = slot_of("doc_id", "text_crc32", "row", slots=slots)
    return rows.withColumn("vslot", F.when(F.col("vslot").isin(opened), dealt).otherwise(F.col("vslot")))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map: slots in turn."""
    return [s % shards for s in range(slots)]


def rebalance(owner: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map with slots moved until no move brings the fullest and the emptiest shard closer.

    Shards that the map names beyond ``shards`` are emptied first. Each step takes the slot of the
    fullest shard whose size is closest to half the gap, so few slots move."""
    owner = list(owner)
    load = [0] * shards
    for slot, shard in enumerate(owner):
        if shard < shards:
            load[shard] += sizes[slot]
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted((s for s, o in enumerate(owner) if o >= shards), key=lambda s: (-sizes[s], s)):
        b, s = heapq.heappop(heap)
        owner[slot] = s
        load[s] = b + sizes[slot]
        heapq.heappush(heap, (load[s], s))
    for _ in range(4 * len(owner)):
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        movable = [s for s, o in enumerate(owner) if o == high and 0 < sizes[s] < gap]
        if not movable:
            break
        slot = min(movable, key=lambda s: (abs(2 * sizes[s] - gap), s))
        owner[slot] = low
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
    return owner


def grow(owner: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map for one shard more: slots move into the new shard only, each from the then fullest one."""
    owner, load = list(owner), [0] * (shards + 1)
    for slot, shard in enumerate(owner):
        load[shard] += sizes[slot]
    target = sum(load) / (shards + 1)
    by_shard = {s: sorted((x for x, o in enumerate(owner) if o == s), key=lambda x: (sizes[x], x)) for s in range(shards)}
    while True:
        high = max(range(shards), key=lambda s: (load[s], -s))
        fits = [x for x in by_shard[high] if 0 < sizes[x] <= target - load[shards] and load[high] - sizes[x] >= target * 0.9]
        if not fits:
            return owner
        slot = fits[-1]
        by_shard[high].remove(slot)
        owner[slot] = shards
        load[high] -= sizes[slot]
        load[shards] += sizes[slot]


def write_map(spark: SparkSession, path: str, version: int, owner: list[int], sizes: list[int], opened: list[int] = ()) -> None:
    """Store a version of the map beside the earlier ones."""
    hot = set(opened)
    rows = [(slot, shard, sizes[slot], slot in hot) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, "vslot int, shard int, bytes long, opened boolean").coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(vslot, shard, bytes, opened, version) of one version, the latest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def digest(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, row): what is needed of each record, read once and written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return settle(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(id_col, slots=slots).alias("vslot"), F.monotonically_increasing_id().alias("row")))


def place(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Shard and gapless position in it for each row of a digest."""
    part = F.shiftright("row", 33)
    mapped = rows.join(F.broadcast(placed.select("vslot", "shard")), "vslot").withColumn("part", part)    # `slots` rows
    counts = mapped.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    slots = counts.groupBy("shard", "vslot").agg(F.sum("n").alias("m"))                                   # `slots` rows
    before = F.sum("m").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("m")
    inner = F.sum("n").over(Window.partitionBy("vslot").orderBy("part")) - F.col("n")
    base = (counts.withColumn("inner", inner).join(F.broadcast(slots.select("vslot", before.alias("before"))), "vslot")
            .select("vslot", "part", (F.col("before") + F.col("inner")).alias("base")))
    nth = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("row")) - 1
    return mapped.withColumn("nth", nth).join(base, ["vslot", "part"]).withColumn("slot", F.col("base") + F.col("nth"))


def shard_by_bytes(docs: DataFrame, shards: int, path: str, slots: int = SLOTS, **cols) -> DataFrame:
    """Shard all records: even map (version 1), hot slots opened and rebalanced by bytes (version 2) under ``path``, rows placed."""
    spark = docs.sparkSession
    rows = digest(docs, slots, **cols)
    sizes = slot_bytes(rows, slots)
    first = even_map(shards, slots)
    write_map(spark, path, 1, first, sizes)
    opened = hot_slots(sizes, shards)
    rows = open_slots(rows, opened, slots)
    sizes = slot_bytes(rows, slots)
    write_map(spark, path, 2, rebalance(first, sizes, shards), sizes, opened)
    return place(rows, read_map(spark, path))
