"""Event history: upsert, retention, equal-window activity, daily counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.functions.dates import DAY, HOUR, moment, seconds_between
from signalloom.functions.numbers import round_half_up
from signalloom.operators.scoring import delta_if_complete

COMPACT_FIELDS = [
    "id", "cluster_id", "title", "published_at", "category", "family", "entity_ids", "significance",
    "source_count", "verification",
]


def compact_event(signals: DataFrame) -> DataFrame:
    return signals.select(*COMPACT_FIELDS)


def merge_today(existing: DataFrame, fresh: DataFrame, key: str | list[str] = "cluster_id") -> DataFrame:
    """Fresh rows replace existing ones of the same key, new ones are added.

    ``max_by`` keeps one row per key with partial aggregation before the shuffle.
    """
    columns = existing.columns
    both = existing.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    kept = F.max_by(F.struct(*columns), F.col("_fresh")).alias("_row")
    keys = [key] if isinstance(key, str) else key
    return both.groupBy(*keys).agg(kept).select("_row.*")


def in_window(t: Column, start: Column, end: Column) -> Column:
    """Half-open: after the start, up to and including the end."""
    return (t > start) & (t <= end)


def staleness_filter(
    items: DataFrame, as_of, max_age_days: int = V.RETENTION_DAYS, at_least: int = V.MIN_FRESH_ITEMS,
    when: str = "published_at",
) -> DataFrame:
    """Drop old items, unless that leaves fewer than ``at_least``."""
    fresh = seconds_between(moment(as_of), F.col(when)) <= max_age_days * DAY
    # one row, decided when the plan runs; a limit first, so that counting ends early
    enough = items.where(fresh).limit(at_least).agg((F.count("*") >= at_least).alias("_enough"))
    return items.join(F.broadcast(enough)).where(fresh | ~F.col("_enough")).drop("_enough")


def prune_retention(events: DataFrame, as_of, days: int = V.RETENTION_DAYS, day: str = "collected_on") -> DataFrame:
    """Keep the day partitions inside the retention; prunes on the partition column."""
    return events.where(F.col(day).cast("timestamp") >= moment(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def history_depth(events: DataFrame, as_of, day: str = "collected_on") -> DataFrame:
    """One row: days since collection began, one decimal."""
    first = F.min(day).cast("timestamp")
    return events.agg(
        F.min(day).alias("first_day"),
        round_half_up(seconds_between(moment(as_of), first) / DAY, 1).alias("history_depth_days"),
    )


def measured_depth(events: DataFrame, as_of, day: str = "collected_on") -> float:
    """Hours since collection began, 0 without history; one number from a one-row aggregate."""
    hours = seconds_between(moment(as_of), F.min(day).cast("timestamp")) / HOUR
    return float(events.agg(F.coalesce(hours, F.lit(0.0))).first()[0])


def _ranges(ranges: dict[str, int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("range"), F.lit(h).alias("hours")) for k, h in ranges.items()])


def _windowed(events: DataFrame, as_of, ranges: dict[str, int], when: str) -> DataFrame:
    """Each event once per range in whose current or prior window it falls.

    One scan serves all ranges, and events outside twice the longest are cut first.
    """
    end = moment(as_of)
    longest = 2 * max(ranges.values())
    return (
        events.where(in_window(F.col(when), end - F.expr(f"INTERVAL {longest} HOURS"), end))
        .select("*", F.inline(_ranges(ranges)))
        .withColumn("_age", seconds_between(end, F.col(when)) / HOUR)
        .withColumn(
            "_now",
            F.when(F.col("_age") < F.col("hours"), F.lit(True)).when(F.col("_age") < 2 * F.col("hours"), F.lit(False)),
        )
        .where(F.col("_now").isNotNull())
    )


def latest_per_cluster(events: DataFrame, key: str = "cluster_id", day: str = "collected_on") -> DataFrame:
    """The last collected record of each cluster."""
    row = F.max_by(F.struct(*events.columns), F.col(day)).alias("_row")
    return events.groupBy(key).agg(row).select("_row.*")


def entity_range(
    events: DataFrame, entities: DataFrame, as_of, depth_hours: float,
    ranges: dict[str, int] = V.RANGE_HOURS, ids: str = "entity_ids", when: str = "published_at",
) -> DataFrame:
    """Per range and entity: ``n`` now, ``previous``, and ``delta`` where the
    history covers the prior window (null elsewhere)."""
    counts = (
        _windowed(events, as_of, ranges, when)
        .select("range", "_now", F.explode(ids).alias("id"))
        .groupBy("range", "id")
        .agg(F.count_if("_now").alias("_n"), F.count_if(~F.col("_now")).alias("_p"))
    )
    grid = entities.select("id").distinct().select("id", F.inline(_ranges(ranges)))
    complete = F.lit(float(depth_hours)) >= 2 * F.col("hours")
    return grid.join(counts, ["range", "id"], "left").select(
        "range", "id",
        F.coalesce("_n", F.lit(0)).alias("n"),
        F.coalesce("_p", F.lit(0)).alias("previous"),
        delta_if_complete(F.coalesce("_n", F.lit(0)), F.coalesce("_p", F.lit(0)), complete).alias("delta"),
        complete.alias("previous_complete"),
    )


def category_range(events: DataFrame, as_of, ranges=V.RANGE_HOURS, when: str = "published_at") -> DataFrame:
    return (
        _windowed(events, as_of, ranges, when).where("_now").groupBy("range", "category")
        .agg(F.count("*").alias("n"))
    )


def range_summary(events: DataFrame, as_of, depth_hours: float, ranges=V.RANGE_HOURS, when: str = "published_at") -> DataFrame:
    spark = events.sparkSession
    grid = spark.range(1).select(F.inline(_ranges(ranges)))
    counts = _windowed(events, as_of, ranges, when).where("_now").groupBy("range").agg(F.count("*").alias("_n"))
    return grid.join(counts, "range", "left").select(
        "range", F.coalesce("_n", F.lit(0)).alias("event_count"),
        (F.lit(float(depth_hours)) >= 2 * F.col("hours")).alias("previous_complete"),
    )


def top_entities(per_range: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` busiest entities of each range; ties in id order."""
    w = Window.partitionBy("range").orderBy(F.desc("n"), "id")
    return (
        per_range.where("n > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("range", "rank", "id", "n", "delta")
    )


def daily_category_counts(events: DataFrame, collected: str = "collected_on", when: str = "published_at") -> DataFrame:
    return events.groupBy(
        F.coalesce(F.col(collected), F.to_date(when)).alias("date"), "category"
    ).agg(F.count("*").alias("n"))


def counts_as_map(counts: DataFrame, by: str, key: str, value: str = "n") -> DataFrame:
    """Long counts as one map per group, for document sinks (keys are a small vocabulary)."""
    entries = F.sort_array(F.collect_list(F.struct(key, value)))
    return counts.groupBy(by).agg(F.map_from_entries(entries).alias("counts"))


def ranges_document(
    events: DataFrame, entities: DataFrame, as_of, depth_hours: float | None = None, ranges: dict[str, int] = V.RANGE_HOURS,
    ids: str = "entity_ids", when: str = "published_at", collected: str = "collected_on", k: int = 8,
) -> DataFrame:
    """The published document, one row per range: totals, entities, categories, the busiest, and the daily series.

    Lists are as long as the dimension, the categories or the days; events are only counted.
    The depth of the history is measured unless it is given.
    """
    depth_hours = measured_depth(events, as_of, collected) if depth_hours is None else depth_hours
    per = entity_range(events, entities, as_of, depth_hours, ranges, ids, when)
    listed = lambda *columns: F.sort_array(F.collect_list(F.struct(*columns)))
    by_entity = per.groupBy("range").agg(listed("id", "n", "previous", "delta").alias("entities"))
    by_category = category_range(events, as_of, ranges, when).groupBy("range").agg(listed("category", "n").alias("categories"))
    top = top_entities(per, k).groupBy("range").agg(listed("rank", "id", "n", "delta").alias("top"))
    daily = daily_category_counts(events, collected, when).agg(listed("date", "category", "n").alias("daily"))
    whole = range_summary(events, as_of, depth_hours, ranges, when)
    for part in (by_entity, by_category, top):
        whole = whole.join(part, "range", "left")
    depth = round_half_up(F.lit(float(depth_hours)) / 24, 1).alias("history_depth_days")
    return whole.join(F.broadcast(daily)).withColumn("generated_at", moment(as_of)).select("*", depth)


def activity_levels(activity: DataFrame, k: int = 4) -> DataFrame:
    """``norm`` of the busiest and whether an entity is among the ``k`` most active.

    The maxima are a one-row aggregate and the top set is a limit, so the
    entity table is never sorted in one task.
    """
    top_n = F.greatest(F.max("n"), F.lit(1)).alias("_max")
    top_d = F.greatest(F.max(F.abs("delta")), F.lit(1)).alias("max_abs_delta")
    best = activity.agg(top_n, top_d)
    top = activity.where("n > 0").orderBy(F.desc("n"), "id").limit(k).select("id", F.lit(True).alias("_top"))
    return (
        activity.join(F.broadcast(best)).join(F.broadcast(top), "id", "left")
        .select("id", "n", (F.col("n") / F.col("_max")).alias("norm"), "max_abs_delta",
                F.coalesce("_top", F.lit(False)).alias("is_top"))
    )


def most_active(activity: DataFrame, k: int = 5) -> DataFrame:
    return activity.where("n > 0").orderBy(F.desc("n"), "id").limit(k)
