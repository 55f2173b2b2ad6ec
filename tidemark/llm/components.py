"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node it is connected with, itself included.

    Every step is one aggregation by node (its smallest neighbour) and a join of
    it back to the edges; nothing gathers the neighbours of a node, and each step
    is written to the shared folder.  A star takes two rounds, a path of n nodes
    about log n.
    """
    edges = cut(_ordered(edges.select("a", "b")), "edges")
    while True:
        before = _sum(edges)
        edges = cut(_small_star(_large_star(edges)), "edges")
        if _sum(edges) == before:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connects every larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connects a node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return _ordered(edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least))


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)
