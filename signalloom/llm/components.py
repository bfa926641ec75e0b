"""Connected components of links between 64-bit nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node's neighbours (the larger ones, or the smaller ones and itself) move to its least neighbour."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` links to ``node, component`` (the least node of each component), for all linked nodes.

    Each round is a few combined aggregations and a join; the rounds grow with the
    logarithm of the longest chain.  A round's table is written, so nothing of it is
    lost with an executor.
    """
    now = written(edges.where("u != v").distinct(), "links")
    mark = None
    while True:
        large = written(_star(now, True), "links-large")
        now = written(_star(large, False), "links-small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(state):
            break
        mark = tuple(state)
    nodes = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
