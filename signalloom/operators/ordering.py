"""Places in an order, without a group in one task.

A range-partitioned sort puts equal keys next to each other; what a task has to know of the
tasks before it is one row per task and group, which windows and joins handle as a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.session import discard, written

_LOW = (1 << 33) - 1


def _ordered(df: DataFrame, *order) -> DataFrame:
    """The rows sorted and written, with their partition ``_part`` and their place in it, ``_at``.

    Sorting reads its input twice, once for the ranges, so the input is written first.
    """
    found = written(df, "unordered")
    marked = written(found.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    discard(found)
    return marked.withColumns({"_part": F.shiftright("_mid", 33), "_at": F.col("_mid").bitwiseAND(F.lit(_LOW))}).drop("_mid")


def _joined(rows: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what ``small`` has for their partition and group; null groups count as a group."""
    named = small.select(F.col("_part").alias("_part2"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in small.columns if c not in ("_part", *by)])
    same = F.col("_part") == F.col("_part2")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(named, same).drop("_part2", *[f"_by{i}" for i in range(len(by))])


def with_positions(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Dense 0-based positions in a global order, without a single-task sort."""
    return grouped_rank(df, [], *order, name=name).withColumn(name, F.col(name) - 1)


def grouped_rank(df: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    """``name``: the 1-based place of every row in its group, by ``order``, for groups of any size.

    Rows are sorted by group and order across all tasks; then rows are counted per task and
    group, and the counts of the tasks before are added to the place inside the task.
    """
    rows = _ordered(df, *by, *order)
    pieces = rows.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    told = _joined(rows, pieces.select("_part", *by, shift.alias("_shift")), by)
    return told.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def fill_forward(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """``name``: the last ``value`` that is not null at or before the row in its group, by ``order``.

    Inside a task it is a window over the task's own rows of the group; what earlier tasks
    leave behind is carried over as one row per task and group.
    """
    rows = _ordered(df, *by, *order)
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = rows.where(F.col(value).isNotNull()).groupBy("_part", *by).agg(F.max_by(value, "_at").alias("_left"))
    parts = rows.select("_part", *by).distinct()
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    ends = parts.join(left.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_left"), same, "left").select("_part", *by, "_left")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", *by, F.last("_left", ignorenulls=True).over(before).alias("_carried"))
    told = _joined(rows.withColumn("_own", F.last(value, ignorenulls=True).over(inside)), carried, by)
    return told.withColumn(name, F.coalesce("_own", "_carried")).drop("_part", "_at", "_own", "_carried")
