"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node with a link to a smaller one has another such link or is itself linked to from a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` of every node with at least one link; the component is its smallest node.

    Each step is a grouping with map-side minima and a join on the node, so a hub is never gathered into one
    list; the number of rounds grows with the logarithm of the longest path, and they end when only stars around the smallest
    nodes are left. Links with a null end, loops and repeated links change nothing; no links give no rows.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    work = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(work):
        work = cut(_small_star(_large_star(work)))
    ends = work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
