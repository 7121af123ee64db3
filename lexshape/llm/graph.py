"""Connected components as joins over written tables; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshape.session import settle


def _state(rows: DataFrame, *cols: str):
    return rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (u, v) edges; a component is named by its smallest node.

    Alternating large and small stars: each round, neighbours above a node are tied to the smallest one around
    it, then neighbours below. Minima are written before they are joined back, so the join of a hub with its
    many neighbours can be split."""
    edges = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges, "u", "v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _state(edges, "u", "v")
        if now == state:
            break
        state = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
