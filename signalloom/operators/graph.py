"""One-hop questions on a directed typed edge table ``(src, dst, type)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_edges(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges both of whose ends exist."""
    known = nodes.select(F.col(key).alias("_id")).distinct()
    return edges.join(known, edges["src"] == F.col("_id"), "left_semi").join(
        known, edges["dst"] == F.col("_id"), "left_semi"
    )


def neighbors(edges: DataFrame) -> DataFrame:
    """Both views of every edge: ``(id, other, type, dir)`` in one pass, no join."""
    views = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("dir")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("dir")),
    )
    return edges.select(F.inline(views))
