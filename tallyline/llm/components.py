"""Connected components of a graph of links, by alternating large and small stars.

Each step moves links towards smaller nodes and is a minimum per node (combined before the
shuffle) and an equi-join, which adaptive execution splits at hubs. No node's links are
ever collected. The edge count never grows, and every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) as (v, m) with m the smallest of u and its (smaller, if not large) links."""
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Every node has one smaller link, or larger ones only: nothing is left to move."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionAll(
        edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    ordered = edges.where("u < v").isEmpty()
    return ordered and sums.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that ``edges`` (u, v) links."""
    now = keep(edges.select("u", "v").where("u <> v").distinct())
    while not _all_stars(now):
        after = keep(_star(_star(now, large=True), large=False))
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
