"""Sinks: the event history, bounded snapshots and published documents."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from signalloom import fixed_values as V
from signalloom.functions.dates import moment
from signalloom.operators.history import merge_today
from signalloom.session import discard, folder_names, remove_path, written


#: Days one upsert may touch; more than a lifetime of daily partitions is a mistake in the input.
MOST_DAYS = 10_000


def touched_days(fresh: DataFrame, day: str = "collected_on") -> list:
    """The distinct days of a batch, as values for a partition filter; their number is checked."""
    days = [r[0] for r in fresh.select(day).distinct().limit(MOST_DAYS + 1).collect()]
    if len(days) > MOST_DAYS:
        raise ValueError(f"an upsert touches more than {MOST_DAYS} days")
    return days


def stored_days(spark: SparkSession, path: str, schema, days: list) -> DataFrame:
    """The stored rows of these days only: other partitions are not listed or read."""
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], schema)
    return stored.where(F.col("collected_on").isin(days))


def upsert_days(fresh: DataFrame, path: str, key: str = "cluster_id") -> None:
    """Upsert rows by ``(collected_on, key)``; only the days they touch are read and rewritten."""
    spark = fresh.sparkSession
    held = written(fresh, "fresh")
    existing = stored_days(spark, path, fresh.schema, touched_days(held)).select(*fresh.columns)
    # the partitions being replaced are also read, so the merge is written out first
    merged = written(merge_today(existing, held, ["collected_on", key]), "merged")
    (
        # a day of any size: adaptive execution splits large ones and joins small ones
        merged.hint("rebalance", "collected_on")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collected_on").parquet(path)
    )
    discard(held, merged)


def write_today(fresh: DataFrame, path: str, day: str, key: str = "cluster_id") -> None:
    """Upsert one day's events."""
    upsert_days(fresh.withColumn("collected_on", F.lit(day).cast("date")), path, key)


def expired_days(events: DataFrame, as_of, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Day partitions outside the retention, for the table service to drop."""
    limit = moment(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return events.select("collected_on").distinct().where(F.col("collected_on").cast("timestamp") < limit)


def drop_expired(spark: SparkSession, path: str, as_of, days: int = V.RETENTION_DAYS) -> list:
    """Delete all day partitions outside the retention; returns the days.

    What is stored is read from the folder's listing, a name a day; no data is read.
    """
    limit = spark.range(1).select(moment(as_of) - F.expr(f"INTERVAL {days} DAYS")).first()[0]
    gone = []
    for name in folder_names(spark, path):
        column, _, value = name.partition("=")
        try:
            day = date.fromisoformat(value)
        except ValueError:  # not a day
            continue
        if column == "collected_on" and datetime(day.year, day.month, day.day) < limit:
            remove_path(spark, f"{path}/{name}")
            gone.append(day)
    return gone


def write_documents(datasets: dict[str, DataFrame], folder: str, fmt: str = "json") -> None:
    """Publish each dataset whole under its name."""
    for name, df in datasets.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")
