"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hung(pairs: DataFrame) -> DataFrame:
    """Each (node, neighbour) with the smallest of the node and its neighbours.

    The pairs stay on the left, where a node with very many can be split.
    """
    least = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    return pairs.join(least, F.col("a") == F.col("node")).withColumn("low", F.least("low", "a"))


def _starred(edges: DataFrame) -> bool:
    """Does every node hang on one other at most, and nothing on a node that hangs?

    Edges lead down, so the middle of each star is then the least of its component.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("held"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    hung = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("held").alias("held"))
    return hung.where("up > 1 OR (up = 1 AND held = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; ``edges`` has (a, b), the label is the least node.

    Rounds alternate large and small stars: neighbours above a node, then those
    below it, are hung on the smallest around it.  The edges never grow in
    number, and the rounds follow the logarithm of the longest path.  Each
    round is written to the shared folder; only whether all are stars
    reaches the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _starred(edges):
        large = _hung(_both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = _hung(large)
        edges = cut(small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
