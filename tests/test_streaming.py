from datetime import datetime

from pyspark.sql import functions as F

from signalloom.streaming import jobs

SCHEMA = "id string, category string, ts timestamp, version long"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_gate_recomputes_only_on_a_newer_version(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    calls = []
    at = datetime(2026, 7, 1)
    for version in (1, 1, 2):
        land(spark, folder, [("a", "p", at, version)])
        source = jobs.stream_ingest(spark, folder, SCHEMA, files_per_trigger=1)
    drain(jobs.stream_change_gate(source, state, "version", calls.append))
    assert calls == [1, 2]


def test_upsert_last_write_wins_per_day(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, h: datetime(2026, 7, d, h)
    writer = lambda: jobs.stream_daily_upsert(
        jobs.stream_ingest(spark, folder, SCHEMA), out, "id", "ts", str(tmp_path / "state"))
    land(spark, folder, [("a", "p", day(1, 1), 1), ("a", "p", day(1, 5), 2), ("b", "p", day(2, 1), 1)])
    drain(writer())
    land(spark, folder, [("a", "q", day(1, 9), 3), ("c", "q", day(1, 2), 1)])
    drain(writer())
    got = sorted((str(r["collected_on"]), r["id"], r["version"]) for r in spark.read.parquet(out).collect())
    assert got == [("2026-07-01", "a", 3), ("2026-07-01", "c", 1), ("2026-07-02", "b", 1)]


def test_late_rows_are_dropped(spark):
    rows = [("a", "p", datetime(2026, 7, 1), 1), ("b", "p", datetime(2026, 4, 1), 1)]
    kept = jobs.stream_late_drop(spark.createDataFrame(rows, SCHEMA), "ts", 60, "2026-07-02 00:00:00")
    assert [r["id"] for r in kept.collect()] == ["a"]


def test_daily_and_sliding_counts_as_batch(spark):
    rows = [("a", "p", datetime(2026, 7, 1, 1), 1), ("b", "p", datetime(2026, 7, 1, 23), 1), ("c", "q", datetime(2026, 7, 2, 3), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    daily = jobs.stream_daily_counts(df, "ts", "category").collect()
    assert sorted((str(r["date"]), r["category"], r["n"]) for r in daily) == [("2026-07-01", "p", 2), ("2026-07-02", "q", 1)]
    sliding = jobs.stream_range_counts(df, "ts", "category").where(F.col("until") == F.lit("2026-07-02 00:00:00").cast("timestamp"))
    assert [(r["category"], r["n"]) for r in sliding.collect()] == [("p", 2)]
