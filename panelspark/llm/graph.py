"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Rows (a, b) with the ``m`` of their a.

    A node may have a large part of the edges: the second join key gives both sides a shuffle
    of their own, whose large partitions Spark can split.
    """
    half = F.pmod(F.xxhash64("b"), F.lit(2))
    return rows.withColumn("_half", half).join(least.withColumn("_half", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))), ["a", "_half"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, least).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = _with_least(edges, least).filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or none, and no node has both kinds."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


def connected_components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(node, component): each node of the edges (a, b) with the smallest node of its component.

    Loops and repeated edges do no harm; nodes without edges are not listed. Each pass is
    written and read again, and ends with every node tied closer to its smallest; the number
    of passes grows with the logarithm of the longest path.
    """
    now = cut_lineage(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        now = cut_lineage(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias(node), F.col("b").alias(component)).distinct()
    return now.select(F.col("a").alias(node), F.col("b").alias(component)).unionByName(roots)
