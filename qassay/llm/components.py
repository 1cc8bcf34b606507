"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("least").alias("a"), "b").filter("a < b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").select(F.col("least").alias("_a"), F.col("a").alias("_b"))
    own = least.select(F.col("least").alias("_a"), F.col("b").alias("_b"))
    return moved.unionByName(own).filter("_a < _b").distinct().select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one single centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("centre"), F.lit(1).alias("leaf")))
    return ends.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).filter("centre + leaf > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges (a, b: long). Self-loops and repeated edges are allowed; nulls drop out.

    Only joins on a node and aggregates with map-side combine, so a node with very many edges is split by skew handling. Each round is
    written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = settle(edges, "edges")
    while not _all_stars(edges):
        edges = settle(_small_star(_large_star(edges)), "edges")
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
