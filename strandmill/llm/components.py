"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) edges, u > v. Minima are combined before the shuffle, so a hub is one row a task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "c")
    near = both.join(least, F.col("u") == F.col("c"))
    moved = near.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is the component's smallest node.

    Loops and null ends are ignored. The steps end when a round changes nothing,
    after a number of rounds that grows with the logarithm of the nodes.
    """
    now = materialize(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while True:
        after = materialize(_step(_step(now, True), False), "edges")
        drop_table(now)
        now = after
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
