"""Connected components by alternating large-star and small-star steps, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, save


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, comp (its component's least node) of every node that an edge (a, b) has; loops and repeats do no harm.

    Each round is written to the shared folder, so plans stay short and a lost executor costs one round at most.
    A node with very many neighbours is reduced by partial aggregation and its join is split by skew handling.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = None
    while True:  # the two stars settle after a number of rounds that grows with the logarithm of the nodes
        ways = _both_ways(edges)
        least = ways.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = ways.where("b > a").join(least, "a").where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        # Now every edge leads from a to a smaller b: the small star of a joins its smaller neighbours and itself.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        before, edges = edges, save(small, f"{name}-edges")
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    # Stars: every edge leads from a node to its component's least node.
    every = edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    every = save(every, name)
    discard(edges)
    return every
