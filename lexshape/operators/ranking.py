"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshape.session import settle


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the row number inside each group, without a task that holds a group.

    A window over the group would sort a hot group in one task. Here the rows
    are range partitioned by (group, order), so a big group is cut into even
    ranges; each range is numbered on its own and shifted by the group's rows in
    the ranges before it. Ranges come from a sample, so the cut is written down
    once (a recomputed cut could differ). ``order`` must be total inside a group."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc() for c in by] + order
    cut = settle(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (group, range): a group has at most as many as there are ranges
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(*by, "_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return (cut.withColumn("_own", own).join(shifts, [*by, "_range"])
            .withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_range", "_own", "_before"))
