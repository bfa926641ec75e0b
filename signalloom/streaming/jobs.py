"""Structured Streaming versions of ingestion, upsert and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from signalloom import fixed_values as V
from signalloom.functions.dates import moment


def stream_ingest(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Poll a landing folder; each file is read once."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_late_drop(items: DataFrame, when: str, max_age_days: int = V.RETENTION_DAYS, as_of=None) -> DataFrame:
    """Ignore what is older than the retention at ``as_of`` (default: processing time)."""
    now = F.current_timestamp() if as_of is None else moment(as_of)
    return items.where(F.col(when) >= now - F.expr(f"INTERVAL {int(max_age_days)} DAYS"))


def stream_dedupe(items: DataFrame, key: str, when: str, delay: str = "1 day") -> DataFrame:
    """A repeated key within the delay is ignored; state is dropped behind the watermark."""
    return items.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def stream_daily_counts(items: DataFrame, when: str, category: str, delay: str = "1 day") -> DataFrame:
    counts = items.withWatermark(when, delay).groupBy(F.window(when, "1 day"), category).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("date"), F.col(category).alias("category"), "n")


def stream_range_counts(
    items: DataFrame, when: str, category: str, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Trailing counts on an hourly grid; the long ranges stay batch."""
    counts = items.withWatermark(when, delay).groupBy(F.window(when, length, slide), category).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.end").alias("until"), F.col(category).alias("category"), "n")


def stream_daily_upsert(items: DataFrame, path: str, key: str, when: str, checkpoint: str):
    """Last write per key and day: each batch rewrites only the days it touches."""
    from signalloom.sources.tables import upsert_days

    def upsert(batch: DataFrame, _: int) -> None:
        last = F.max_by(F.struct(*batch.columns), F.col(when)).alias("_r")
        daily = batch.groupBy(F.to_date(when).alias("collected_on"), key).agg(last)
        upsert_days(daily.select("collected_on", "_r.*"), path, key)

    return items.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def last_version(spark: SparkSession, checkpoint: str):
    """The version a change gate computed last, from beside its checkpoint; None before the first."""
    try:
        stored = spark.read.parquet(f"{checkpoint}-version")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return stored.agg(F.max("version")).first()[0]


def stream_change_gate(versions: DataFrame, checkpoint: str, version: str, recompute):
    """Call ``recompute(version)`` only when a batch brings a newer version than the last one computed.

    The last version is appended beside the checkpoint after each computation, so a job
    that starts again goes on from there; one that stops in between computes once more.
    """

    def gate(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max(version).alias("version"))
        row, last = newest.first(), last_version(spark, checkpoint)
        if row["version"] is not None and (last is None or row["version"] > last):
            recompute(row["version"])
            newest.write.mode("append").parquet(f"{checkpoint}-version")

    return versions.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint)
