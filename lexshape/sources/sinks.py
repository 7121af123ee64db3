"""Writers: partitioned index tables with a manifest of their keys, bucketed tables, the JSON export and the version log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshape.functions.unicode import slug
from lexshape.session import settle

LAYOUT, MANIFEST = "_layout", "_manifest"    # readers of the table pass over names with an underscore


class VersionTaken(ValueError):
    """Another publisher was first with this place in the version log."""


def write_partitioned(table: DataFrame, path: str, key: str, buckets: int, dynamic: bool = False) -> None:
    """Write a table by hashed buckets of its key; their number and the key's type are kept beside the data.

    One folder per bucket, not per key (keys are thousands). A reader that knows
    the key prunes to one bucket: see ``read_key``. ``dynamic`` rebuilds only the
    buckets present; the default replaces the table, so nothing stale stays. The manifest beside
    the data lists the keys, for ``sweep_stale``."""
    bucketed = table.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # the rebalance hint cuts large buckets into files by their size
    writer = bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write
    mode = "dynamic" if dynamic else "static"
    spark, layout = table.sparkSession, {"key": key, "type": table.schema[key].dataType.simpleString(), "buckets": buckets}
    if dynamic and (kept := _layout(spark, path)) != layout:
        raise ValueError(f"{path} is laid out by {kept}, not by {layout}")
    writer.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(path)
    _write_manifest(spark.read.schema(bucketed.schema).parquet(path).select(key, "bucket"), path, "static")
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{LAYOUT}")


def _write_manifest(keys: DataFrame, path: str, mode: str) -> None:
    """The keys of a table by bucket: all of them, or with ``dynamic`` those of the buckets that were rewritten."""
    keys.distinct().write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{path}/{MANIFEST}")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by the session's Hadoop configuration."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, bucket) of every key that the table holds."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def sweep_stale(spark: SparkSession, path: str, emitted: DataFrame) -> int:
    """Drop the keys that a build no longer ``emitted`` (rows with the key column); the number of keys dropped.

    The manifest of the table is held against the emitted keys. Buckets with stale keys are rewritten without them; a bucket
    whose keys all vanished is removed, which an overwrite by partitions alone would leave. Other buckets keep their files."""
    key = _layout(spark, path)["key"]
    stale = settle(manifest(spark, path).join(emitted.select(key).distinct(), key, "left_anti"))
    touched = [r["bucket"] for r in stale.select("bucket").distinct().collect()]             # at most one row a bucket
    if touched:
        kept = settle(spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(stale.select(key), key, "left_anti"))
        kept.sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        _write_manifest(kept.select(key, "bucket"), path, "dynamic")
        held = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
        for bucket in set(touched) - held:
            for root in (path, f"{path}/{MANIFEST}"):
                fs, folder = _folder(spark, f"{root}/bucket={bucket}")
                fs.delete(folder, True)
    return stale.count()


def _layout(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{LAYOUT}").first()["value"])


def read_key(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """Rows of one key; only its bucket folder is scanned. The layout kept beside the data says which."""
    layout = _layout(spark, path)
    if key != layout["key"]:
        raise ValueError(f"{path} is laid out by {layout['key']}, not by {key}")
    typed = F.lit(value).cast(layout["type"])
    at = spark.range(1).select(F.pmod(F.xxhash64(typed), F.lit(layout["buckets"])).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == at) & (F.col(key) == typed)).drop("bucket")


def read_keys(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """Rows of some keys; only their bucket folders are scanned."""
    layout = _layout(spark, path)
    if key != layout["key"]:
        raise ValueError(f"{path} is laid out by {layout['key']}, not by {key}")
    typed = F.array(*[F.lit(v).cast(layout["type"]) for v in values])
    at = spark.range(1).select(F.transform(typed, lambda v: F.pmod(F.xxhash64(v), F.lit(layout["buckets"])).cast("int"))).first()[0]
    return spark.read.parquet(path).where(F.col("bucket").isin(at) & F.col(key).isin(values)).drop("bucket")


def write_index(tables: dict[str, DataFrame], path: str, keys: dict[str, str], buckets: int) -> None:
    """Write the index tables; those with a key are bucketed by it."""
    for name, table in tables.items():
        if name in keys:
            write_partitioned(table, f"{path}/{name}", keys[name], buckets)
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def export_json(table: DataFrame, path: str, key: str) -> None:
    """JSON-lines export, one record per key with a file-name-safe ``slug``."""
    record = table.withColumn("slug", slug(F.col(key)))
    record.select(F.to_json(F.struct(*record.columns)).alias("value")).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], database: str, keys: dict[str, str], buckets: int, path: str) -> None:
    """Write tables as Spark tables ``database.name`` under ``path``, bucketed and sorted by their key: tables with one key join without a shuffle."""
    spark = next(iter(tables.values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{path}'")
    for name, table in tables.items():
        key = keys[name]
        # one file a bucket, and only one sort
        dealt = table.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        dealt.mode("overwrite").option("path", f"{path}/{name}").saveAsTable(f"{database}.{name}")


def _log(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
    """Complete entries of a version log, the last first."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder) or not any(f.getPath().getName().endswith(".json") for f in fs.listStatus(folder)):
        return []
    rows = spark.read.text(f"{path}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").orderBy(F.desc("file")).collect()
    found = []
    for r in rows:
        try:
            found.append((int(r["file"].split(".")[0]), json.loads(r["value"])))
        except ValueError:        # an entry that is being written
            continue
    return found


def last_entry(spark: SparkSession, path: str) -> int:
    """The number of the last complete entry of a version log; 0 where there is none."""
    return max((n for n, _ in _log(spark, path)), default=0)


def versions(spark: SparkSession, path: str) -> set[str]:
    """Names of the complete entries of a version log."""
    return {entry["version"] for _, entry in _log(spark, path)}


def publish_version(spark: SparkSession, path: str, version: str, folder: str, chunked: bool = True, after: int | None = None) -> int:
    """Point readers at a finished build: a new entry in the log at ``path``, written last, after the build's data.

    Entries are numbered and only ever added; an entry is created only where none is, so of two publishers that
    follow the same entry (``after``, by default the last) one is refused. Readers always find the last complete entry."""
    last = last_entry(spark, path) if after is None else after
    fs, place = _folder(spark, f"{path}/{last + 1:010d}.json")
    try:
        out = fs.create(place, False)
    except Exception as why:
        if "AlreadyExists" in str(why) or "already exists" in str(why):
            raise VersionTaken(f"entry {last + 1} of {path} is taken; {version} was not published") from None
        raise
    out.write(bytearray(json.dumps({"version": version, "dir": folder, "chunked": chunked}).encode()))
    out.close()
    return last + 1


def current_version(spark: SparkSession, path: str) -> dict:
    """What the last complete entry of the version log points at."""
    found = _log(spark, path)
    if not found:
        raise ValueError(f"nothing is published at {path}")
    return found[0][1]
