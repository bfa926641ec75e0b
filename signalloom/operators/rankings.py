"""Ranked views, shares and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.numbers import clamp, round_half_up
from signalloom.operators.ordering import fill_forward


def rank_with_ties(rows: DataFrame, view: str = "view", show_index: bool = False) -> DataFrame:
    """Adds ``rank_label`` ("T-" on shared ranks) and ``bar_pct``.

    Shared ranks and the best score are small aggregates joined back, so a view
    that holds most rows is reduced before it is shuffled.
    """
    shared = rows.groupBy(view, "rank").agg(F.count("*").alias("_same"))
    best = rows.groupBy(view).agg(F.max("score").alias("_best"))
    index = clamp(F.col("w").cast("double"), 0.0, 100.0) if show_index else F.lit(None).cast("double")
    bar = F.when(
        F.col("score").isNotNull(), F.coalesce(round_half_up(F.try_divide("score", "_best") * 100), F.lit(0.0))
    ).otherwise(index)
    label = F.concat(
        F.when(F.col("_same") > 1, F.lit("T-")).otherwise(F.lit("")),
        F.when(F.length(F.col("rank").cast("string")) < 2, F.lpad(F.col("rank").cast("string"), 2, "0"))
        .otherwise(F.col("rank").cast("string")),
    )
    return (
        rows.join(shared, [view, "rank"]).join(best, view)
        .withColumns({"rank_label": label, "bar_pct": bar}).drop("_same", "_best")
    )


def rank_tie_counts(rows: DataFrame, view: str = "view") -> DataFrame:
    return rows.groupBy(view, "rank").agg(F.count("*").alias("n"))


def cumulative_share(shares: DataFrame, order: str, pct: str = "pct", by: str = "view") -> DataFrame:
    """Running ``start`` and ``end`` of each share of a view.

    A view lists the named parts of one whole - a dimension, not raw rows.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(pct).over(w)
    return shares.withColumn("end", end).withColumn("start", F.col("end") - F.col(pct))


def segment_at_pct(segments: DataFrame, points: DataFrame, by: str = "view", order: str = "ord") -> DataFrame:
    """The share each percentage falls in; past the end, the last share.

    A point belongs to the first share that ends beyond it.  Shares and points are sorted
    together, from the greatest down, and every point takes the last share before it: one
    scan of the points, no join of a view's points with its shares.  A view's shares are a
    dimension (see :func:`cumulative_share`); its points may be any number.
    """
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1
    kept = [c for c in segments.columns if c != by]
    ends = segments.select(
        F.col(by), F.when(last, F.lit(float("inf"))).otherwise(F.col("end").cast("double")).alias("_at"),
        F.struct(*kept).alias("_segment"), F.lit(None).cast(points.schema["point"].dataType).alias("point"),
    )
    asked = points.where(F.col("point").isNotNull()).select(F.col(by), F.col("point").cast("double").alias("_at"), F.lit(None).cast(ends.schema["_segment"].dataType).alias("_segment"), "point")
    # a share that ends at a point does not hold it: of equal places points come first
    down = [F.desc("_at"), F.col("_segment").isNotNull(), F.desc(f"_segment.{order}")]
    found = fill_forward(ends.unionByName(asked), [by], down, "_segment", "_found")
    return found.where("point IS NOT NULL AND _found IS NOT NULL").select(by, "point", "_found.*")


def scale_to_max(df: DataFrame, value: str, by: list[str], name: str = "scaled", root: bool = False) -> DataFrame:
    """Value over the largest of its group, optionally by area (square root)."""
    best = df.groupBy(*by).agg(F.max(value).alias("_best"))
    ratio = F.try_divide(F.col(value), F.col("_best"))
    return df.join(best, by).withColumn(name, F.sqrt(ratio) if root else ratio).drop("_best")


def newest(df: DataFrame, when: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the chronological stream."""
    ordered = df.orderBy(F.col(when).desc(), tie)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def top_k(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark keeps ``k`` per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def roster_differences(rows: DataFrame, view: str = "view", member: str = "item") -> DataFrame:
    """Members that are not listed in every view, with the number of views they miss."""
    views = rows.agg(F.count_distinct(view).alias("_views"))
    seen = rows.groupBy(member).agg(F.count_distinct(view).alias("_seen"))
    return seen.join(F.broadcast(views)).where("_seen < _views").select(
        member, (F.col("_views") - F.col("_seen")).alias("missing")
    )


def registry_drift(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two datasets or exists in one only."""
    left = a.select(key, F.col(value).alias("left_value"))
    right = b.select(key, F.col(value).alias("right_value"))
    return left.join(right, key, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
