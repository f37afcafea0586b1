"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are joins and minima by key: minima are combined before the shuffle, hub rows
are spread by skew-join handling, and nothing of the graph reaches the driver but two counts
a round. Each round is checkpointed; rounds end when all edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, dealt_anew


def _left(edges: DataFrame) -> tuple[int, int]:
    """Nodes that keep the edges from being stars around least nodes, and the number of edges."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("over"), F.lit(0).alias("under")).union(edges.select("b", F.lit(0), F.lit(1)))
    node = ends.groupBy("node").agg(F.max("over").alias("over"), F.sum("under").alias("under"))
    amiss = F.when(((F.col("over") == 1) & (F.col("under") > 0)) | (F.col("under") > 1), 1).otherwise(0)
    return tuple(node.agg(F.coalesce(F.sum(amiss), F.lit(0)), F.coalesce(F.sum("under"), F.lit(0))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (least node reachable) of every node that has a link to another."""
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    left, n = _left(edges)
    while left:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(dealt_anew("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        side = large.join(down, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = cut(side.union(down.select(F.col("m").alias("a"), "b")).distinct(), 2 * n)
        left, n = _left(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
