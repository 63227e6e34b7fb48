"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component's name is its least node.

    Each round is two aggregates and two joins on rows of two numbers, cut from lineage; rounds grow
    with the logarithm of the longest chain. Loops, repeated edges and both directions may occur."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _checksum(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.filter("b > a").join(least, "a").filter("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select("b", F.col("b").alias("component")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
