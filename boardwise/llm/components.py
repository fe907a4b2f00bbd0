"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(edges: DataFrame) -> bool:
    """Whether every node a has one edge, to a node that has none of its own. As steps keep what is connected, such stars
    are the components."""
    size = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
    return size[0] == size[1] and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of edges (a, b); none for an empty table.

    Alternates two steps until only stars are left. The first links each node's larger neighbours to its smallest
    neighbour, the second its smaller ones and itself; components end as stars around their smallest nodes. Minima
    come from partial aggregation and are joined back, so that no node's neighbours are ever gathered; Spark splits
    the skewed partitions of those joins. Each round is checkpointed, which keeps the plan short and survives lost
    executors.
    """
    at = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(at):
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least)
        at = checkpointed(small.distinct())
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
