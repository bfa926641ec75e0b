from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalloom.operators import history as H
from signalloom.operators import quality as Q
from signalloom.operators.videos import stage_counts
from signalloom.session import shared_folder, written
from signalloom.sources import readers, tables

EVENT = "cluster_id string, category string, entity_ids array<string>, published_at timestamp"


def events(spark, *rows):
    return spark.createDataFrame([(f"c{i}", c, e, datetime(2026, 7, d, h)) for i, (c, e, d, h) in enumerate(rows)], EVENT)


def test_windows_are_equal_and_half_open(spark):
    df = events(spark, ("p", ["a"], 10, 0), ("p", ["a"], 9, 0), ("p", ["a", "z"], 9, 1), ("q", ["b"], 8, 1), ("q", ["b"], 11, 0))
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: tuple(r)[2:] for r in H.entity_range(df, nodes, "2026-07-10 00:00:00", 48, {"24H": 24}).collect()}
    assert got == {"a": (2, 1, 1, True), "b": (0, 1, -1, True), "c": (0, 0, 0, True)}
    short = H.entity_range(df, nodes, "2026-07-10 00:00:00", 47, {"24H": 24}).collect()
    assert {r["delta"] for r in short} == {None}
    top = H.top_entities(H.entity_range(df, nodes, "2026-07-10 00:00:00", 48, {"24H": 24})).collect()
    assert [(r["id"], r["n"]) for r in top] == [("a", 2)]


def test_staleness_keeps_all_when_sparse(spark):
    df = events(spark, ("p", [], 10, 0), ("p", [], 1, 0))
    assert H.staleness_filter(df, "2026-07-10 00:00:00", 2).count() == 2
    assert H.staleness_filter(df, "2026-07-10 00:00:00", 2, at_least=1).count() == 1


def test_upsert_rewrites_one_day(spark, tmp_path):
    path = str(tmp_path / "events")
    first = spark.createDataFrame([("c1", 1), ("c2", 1)], "cluster_id string, v int")
    tables.write_today(first, path, "2026-07-01")
    tables.write_today(first, path, "2026-07-02")
    tables.write_today(spark.createDataFrame([("c2", 2), ("c3", 2)], "cluster_id string, v int"), path, "2026-07-02")
    got = sorted((str(r["collected_on"]), r["cluster_id"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("2026-07-01", "c1", 1), ("2026-07-01", "c2", 1), ("2026-07-02", "c1", 1), ("2026-07-02", "c2", 2), ("2026-07-02", "c3", 2)]
    assert readers.read_history(spark, path, "2026-07-02").count() == 3
    kept = H.prune_retention(spark.read.parquet(path), "2026-07-03 00:00:00", 1)
    assert {str(r["collected_on"]) for r in kept.collect()} == {"2026-07-02"}
    assert [str(r[0]) for r in tables.expired_days(spark.read.parquet(path), "2026-07-03 00:00:00", 1).collect()] == ["2026-07-01"]


def test_documents_and_dimensions(spark, tmp_path):
    tables.write_documents({"signals": spark.range(3)}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "signals")).count() == 3
    (tmp_path / "e.json").write_text('{"nodes":[{"id":"a","importance":9,"match":["x"]}],"connections":[{"from":"a","to":"b","type":"depends"}]}')
    nodes = readers.load_entities(spark, str(tmp_path / "e.json"))
    assert readers.entity_rules(nodes) == [{"id": "a", "importance": 9, "match": ["x"]}]
    assert [tuple(r) for r in readers.load_edges(spark, str(tmp_path / "e.json")).collect()] == [("a", "b", "depends")]
    assert readers.optional_source(spark, str(tmp_path / "none.json"), "a int").count() == 0
    with pytest.raises(ValueError):
        readers.entity_rules(nodes, at_most=0)


def test_dimensions_from_many_documents(spark, tmp_path):
    """One document a line, spread over tasks; what is no JSON, or of another type, is told."""
    lines = ['{"nodes":[{"id":"n%d","importance":%d}]}' % (i, i) for i in range(200)] + ['{"nodes":[{"id":"cut"', '{"nodes":"none"}', ""]
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(6).write.text(str(tmp_path / "dims"))
    path = str(tmp_path / "dims")
    assert readers.load_entities(spark, path, lines=True).count() == 200
    documents = readers.load_documents(spark, path, True, nodes=readers.ENTITY_SCHEMA)
    assert sorted(r[0] for r in readers.broken_documents(documents).collect()) == ['{"nodes":"none"}', '{"nodes":[{"id":"cut"']
    assert documents.rdd.getNumPartitions() > 1
    (tmp_path / "r.json").write_text('{\n "models": [{"key": "a", "name": "A", "entity_id": "e", "queries": {"forum": "q"}}]\n}')
    registry = readers.load_registry(spark, str(tmp_path / "r.json"))
    found = readers.model_lookup(spark.createDataFrame([("e",), ("x",)], "entity_id string"), registry)
    assert sorted((r["entity_id"], r["name"], (r["queries"] or {}).get("forum")) for r in found.collect()) == [("e", "A", "q"), ("x", None, None)]
    (tmp_path / "v.json").write_text('{"views":[{"view":"v","snapshot":"2026-07-30","rows":[{"rank":1,"item":"a","score":61},{"rank":1,"item":"b","score":60.5}]},{"view":"w","rows":[]}]}')
    views = [tuple(r)[:6] for r in readers.load_views(spark, str(tmp_path / "v.json")).orderBy("ord").collect()]
    assert views == [("v", "2026-07-30", 0, 1, "a", None), ("v", "2026-07-30", 1, 1, "b", None)]


def test_all_expired_days_go_without_reading(spark, tmp_path):
    path = tmp_path / "events"
    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)] + ["2026-07-01", "2026-07-02"]
    for day in days:
        (path / f"collected_on={day}").mkdir(parents=True)
        (path / f"collected_on={day}" / "part.parquet").write_text("not read")
    (path / "collected_on=__HIVE_DEFAULT_PARTITION__").mkdir()
    (path / "_spark_metadata").mkdir()
    gone = tables.drop_expired(spark, str(path), "2026-07-03 00:00:00", 1)
    assert [str(d) for d in gone] == days[:-1]
    assert sorted(p.name for p in path.iterdir()) == ["_spark_metadata", "collected_on=2026-07-02", "collected_on=__HIVE_DEFAULT_PARTITION__"]
    assert tables.drop_expired(spark, str(tmp_path / "none"), "2026-07-03 00:00:00") == []


def test_skipped_files_are_the_unreadable_ones(spark, tmp_path):
    path = tmp_path / "events"
    day = path / "collected_on=2026-07-02"
    spark.range(3).write.parquet(str(day))
    spark.range(0).write.mode("append").parquet(str(day))  # sound, without rows
    (day / "z.parquet").write_text("no table")
    found = [r["file"].rsplit("/", 1)[1] for r in readers.skipped_files(spark, str(path)).collect()]
    assert found == ["z.parquet"]
    assert readers.skipped_files(spark, str(path), "2026-07-03").count() == 0


def test_optional_dataset_absent_sound_and_malformed(spark, tmp_path):
    schema = spark.range(1).selectExpr("id", "'x' AS name", "1.5D AS score").schema
    told = lambda name: sorted((r["row_key"], r["detail"]) for r in Q.stored_as_declared(spark, str(tmp_path / name), schema, name).collect())
    assert told("absent") == []
    spark.range(5).selectExpr("id", "'x' AS name", "1.5D AS score", "2 AS more").write.parquet(str(tmp_path / "sound"))
    assert told("sound") == []
    spark.range(5).selectExpr("CAST(id AS int) AS id", "'x' AS name").write.parquet(str(tmp_path / "bad"))
    (tmp_path / "bad" / "x.parquet").write_text("PAR1")
    assert told("bad") == [("files", "unreadable=1"), ("id", "int32 for int64"), ("score", "missing")]


def test_depth_is_measured(spark):
    df = spark.createDataFrame([("2026-07-01",), ("2026-07-09",)], "d string").select(F.to_date("d").alias("collected_on"))
    assert H.measured_depth(df, "2026-07-10 12:00:00") == 9.5 * 24
    assert H.measured_depth(df.limit(0), "2026-07-10 12:00:00") == 0.0


def test_written_is_durable(spark):
    df = written(spark.range(5).withColumn("x", F.rand()), "t")
    assert df.collect() == df.collect()
    assert shared_folder(spark)


def test_stage_counts(spark):
    df, seen = stage_counts(spark.range(7), "raw")
    df.collect()
    assert seen.get["rows"] == 7


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "ok", 5.0, "2026-01-01", ["a"]), (2, " ", float("nan"), "bad", [])], "id int, t string, v double, d string, a array<string>"
    )
    found = Q.check_rows(df, "x", F.col("id"), [
        Q.not_blank("t"), Q.finite_range("v", 0, 10), Q.valid_timestamp("d"), Q.non_empty_array("a"), Q.one_of("t", ["ok"]),
    ]).collect()
    assert {(r["rule"], r["row_key"]) for r in found} == {(n, "2") for n in ("not_blank", "finite_range", "valid_timestamp", "required_collection", "enum")}
    known = spark.createDataFrame([("b",)], "k string")
    assert [r["detail"] for r in Q.foreign_key(df, "x", "id", "a", known, "k").collect()] == ["a"]
    lists = spark.createDataFrame([("l", 1, 5), ("l", 2, 7), ("l", 3, 6)], "l string, n int, v int")
    assert [r["row_key"] for r in Q.sorted_descending(lists, "x", "l", "n", "v").collect()] == ["l|2"]
