"""Rules that a plain reading of small inputs settles."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from signalloom.functions.text import decode_entities
from signalloom.operators import community as K
from signalloom.operators import market as M
from signalloom.operators import sections as P
from signalloom.operators.entities import link_terms
from signalloom.sources import media, readers, tables


def test_long_terms_link(spark):
    texts = spark.createDataFrame([(1, "In the United States of America, now"), (2, "united states"), (3, None)], "k int, t string")
    terms = spark.createDataFrame([("usa", "united states of america"), ("us", "United States"), ("x", "")], "id string, term string")
    got = {tuple(r) for r in link_terms(texts, "k", "t", terms).collect()}
    assert got == {(1, "usa"), (1, "us"), (2, "us")}
    assert link_terms(texts, "k", "t", terms.limit(0)).count() == 0


def test_numeric_references_with_leading_zeros(spark):
    rows = spark.createDataFrame([("&#0000000065;&#x000000042;&#99999999999;&#0;",)], "t string")
    assert rows.select(decode_entities(F.col("t"))).first()[0] == "AB&#99999999999;&#0;"


def test_paging_stops_at_total_short_page_and_gap(spark):
    rows = [("total", p, 200, 100) for p in range(3)] + [("short", 0, 900, 100), ("short", 1, 900, 40), ("short", 2, 900, 100)]
    rows += [("gap", 0, 900, 100), ("gap", 2, 900, 100), ("late", 1, 900, 100), ("long", 0, 900, 100), ("long", 1, 900, 100), ("long", 2, 900, 100), ("long", 3, 900, 100)]
    got = {r["q"]: r["fetched_count"] for r in K.paginate(spark.createDataFrame(rows, "q string, page int, nb_hits long, page_hits long"), ["q"]).collect()}
    assert got == {"total": 200, "short": 140, "gap": 100, "long": 300}


def test_a_response_without_a_result_loses_one_ticker(spark):
    good = '{"chart":{"result":[{"timestamp":[86400],"indicators":{"quote":[{"close":[2.0]}]}}]}}'
    bodies = [("a", good), ("b", '{"chart":{"result":[]}}'), ("c", '{"chart":{"result":[{"timestamp":[1],"indicators":{"quote":[]}}]}}'), ("d", "no json")]
    responses = spark.createDataFrame(bodies, "ticker string, body string")
    assert [r["ticker"] for r in media.parse_price_bars(responses).collect()] == ["a"]
    assert media.parse_live_prices(responses).count() == 4


def test_an_upsert_reads_only_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(f"c{i}", datetime(2026, 7, 1 + i % 5).date()) for i in range(20)]
    tables.upsert_days(spark.createDataFrame(rows, "cluster_id string, collected_on date"), path)
    fresh = spark.createDataFrame([("c0", datetime(2026, 7, 2).date())], "cluster_id string, collected_on date")
    touched = tables.touched_days(fresh)
    plan = tables.stored_days(spark, path, fresh.schema, touched)._jdf.queryExecution().executedPlan().toString()
    assert "collected_on" in plan.split("PartitionFilters: [")[1].split("]")[0]
    tables.upsert_days(fresh, path)
    assert spark.read.parquet(path).count() == 21
    assert [str(d) for d in tables.drop_expired(spark, path, "2026-07-05 00:00:00", 2)] == ["2026-07-01", "2026-07-02"]
    assert spark.read.parquet(path).count() == 12


def test_skipped_files_are_told(spark, tmp_path):
    path = tmp_path / "events"
    rows = [("a", datetime(2026, 7, 1).date()), ("b", datetime(2026, 7, 2).date())]
    tables.upsert_days(spark.createDataFrame(rows, "cluster_id string, collected_on date"), str(path))
    (path / "collected_on=2026-07-02" / "part-bad.parquet").write_bytes(b"not parquet at all")
    assert sorted(r["cluster_id"] for r in spark.read.schema("cluster_id string, collected_on date").option("ignoreCorruptFiles", "true").parquet(str(path)).collect()) == ["a", "b"]
    skipped = [r["file"] for r in readers.skipped_files(spark, str(path)).collect()]
    assert len(skipped) == 1 and skipped[0].endswith("part-bad.parquet")


def test_ranks_inside_families_and_previews(spark):
    at = datetime(2026, 7, 10)
    rows = [(i, ["product", "policy"][i % 2], [5, 9, 5, None, 7][i % 5], at) for i in range(12)]
    signals = spark.createDataFrame(rows, "id int, category string, significance int, published_at timestamp")
    got = {}
    for r in P.ranked_families(signals, "2026-07-10 06:00:00").collect():
        got.setdefault(r["family"], []).append((r["rank"], -(r["significance"] or 0), r["id"]))
    for ranks in got.values():
        ranks.sort()
        assert [r for r, *_ in ranks] == list(range(1, len(ranks) + 1)) and [x[1:] for x in ranks] == sorted(x[1:] for x in ranks)
    panels = P.latest_previews(signals, signals.limit(4), ticker=2, lead=1, newest=3).collect()
    assert [(r["panel"], r["rank"]) for r in panels].count(("river", 3)) == 1 and len(panels) == 6


def test_stock_figures_fall_back(spark):
    stocks = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0)], "ticker string, shares double")
    bars = spark.createDataFrame([("a", 10), ("b", 20)], "ticker string, volume long")
    live = spark.createDataFrame([("a", 3.0, None), ("b", 4.0, 7)], "ticker string, live_price double, live_volume long")
    got = {r["ticker"]: (r["price"], r["volume"], r["market_cap"], r["dollar_volume"]) for r in M.stock_nodes(stocks, bars, live).collect()}
    assert got == {"a": (3.0, 10, 6e9, 30.0), "b": (4.0, 7, None, 28.0), "c": (None, None, None, None)}


def test_at_most_days(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_DAYS", 1)
    rows = spark.createDataFrame([(datetime(2026, 7, d).date(),) for d in (1, 2)], "collected_on date")
    with pytest.raises(ValueError):
        tables.touched_days(rows)


def test_community_record_merges_unlike_voices(spark):
    at = lambda d: datetime(2026, 7, d)
    shape = "comment_id long, model string, match_confidence double, topics array<string>, text string, published_at timestamp"
    comments = [(i, "a", 0.5 + i / 10, ["speed"], f"talk{i} about release{i} number{i}", at(5)) for i in range(5)] + [(9, "a", 0.9, [], "nothing here", at(5))]
    posts = [(20, "a", 1, ["price"], "talk4 about release4 number4", at(9)), (21, "a", 1, ["price"], "newest post alpha", at(8)),
             (22, "a", 1, ["price"], "other post beta", at(7)), (23, "a", 2, ["price"], "second topic gamma", at(6)), (24, "a", 3, [], "without theme", at(9))]
    board = [(30, "a", ["price"], "second topic gamma", at(9)), (31, "a", ["price"], "board thread delta", at(8))]
    themes, voices = K.community_record(
        spark.createDataFrame(comments, shape), ["a", "b"], "2026-07-10 00:00:00",
        spark.createDataFrame(posts, "comment_id long, model string, topic_id long, topics array<string>, text string, published_at timestamp"),
        spark.createDataFrame(board, "comment_id long, model string, topics array<string>, text string, published_at timestamp"),
    )
    assert {tuple(r) for r in themes.collect()} == {("a", "speed", 5), ("a", "price", 6)}
    shown = [(r["source"], r["comment_id"]) for r in sorted(voices.collect(), key=lambda r: r["position"])]
    # post 20 repeats a chosen comment, 22 stands in the topic of 21, thread 30 repeats post 23
    assert shown == [("forum", 21), ("board", 31), ("comments", 4), ("forum", 23), ("comments", 3), ("comments", 2), ("comments", 1)]
