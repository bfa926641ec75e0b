import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators import community as K
from signalloom.operators import rankings as R
from signalloom.operators import sections as P
from signalloom.operators.ordering import _ordered, fill_forward, grouped_rank, with_positions
from signalloom.operators.similarity import coded, token_codes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_in_groups_of_any_size(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(9)
    out = {(r["g"], r["id"]): r["rank"] for r in grouped_rank(df, ["g"], F.desc("v"), F.col("id")).collect()}
    want = {}
    for g in ("a", "b", None):
        for n, (_, i) in enumerate(sorted((-v, i) for h, v, i in rows if h == g), 1):
            want[(g, i)] = n
    assert out == want


def test_positions_of_an_empty_table(spark):
    assert with_positions(spark.range(0), F.col("id")).count() == 0
    assert grouped_rank(spark.range(0).withColumn("g", F.lit(1)), ["g"], F.col("id")).count() == 0


def test_last_value_before_in_groups_over_all_tasks(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aaab"), i, f"v{i}" if rnd.random() < 0.05 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, v string").repartition(8)
    out = {(r["g"], r["at"]): r["f"] for r in fill_forward(df, ["g"], [F.col("at")], "v", "f").collect()}
    last, want = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        last[g] = v or last.get(g)
        want[(g, at)] = last[g]
    assert out == want


def test_no_window_over_a_whole_family_or_model(spark):
    """All rows in one family, in one model: no task numbers or holds more than its share."""
    rows = spark.range(20_000).select(
        F.lit("product").alias("category"), F.lit(50).alias("significance"), F.col("id"), F.lit("2026-01-02 00:00:00").cast("timestamp").alias("published_at"),
        F.lit("m").alias("model"), F.lit("forum").alias("source"), F.col("id").alias("place"),
    )
    ranked = P.ranked_families(rows, "2026-01-03 00:00:00")
    merged = K.interleave(rows, "model", "source", "place", ["forum", "board"])
    for df, name in ((ranked, "rank"), (merged, "position")):
        assert sorted(r[0] for r in df.select(name).collect()) == list(range(1, 20_001))
        assert "row_number" not in plan_of(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these are few rows
    try:
        sizes = [r["count"] for r in _ordered(rows, "model", "place").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 7 and max(sizes) < 5000


def test_segments_by_sorted_merge(spark):
    shares = spark.createDataFrame([("a", 0, 30.0, "x"), ("a", 1, 0.0, "y"), ("a", 2, 50.0, "z"), ("b", 0, 10.0, "w")], "view string, ord int, pct double, item string")
    segments = R.cumulative_share(shares, "ord")
    points = spark.createDataFrame([("a", p) for p in (-5, 0, 29, 30, 79, 80, 200)] + [("b", 10), ("b", 9), ("c", 5), ("a", None)], "view string, point int")
    found = R.segment_at_pct(segments, points)
    out = {(r["view"], r["point"]): r["item"] for r in found.collect()}
    assert out == {("a", -5): "x", ("a", 0): "x", ("a", 29): "x", ("a", 30): "z", ("a", 79): "z", ("a", 80): "z", ("a", 200): "z", ("b", 10): "w", ("b", 9): "w"}
    assert "Join [view" not in plan_of(found)


def test_a_common_word_spreads_over_all_tasks(spark, monkeypatch):
    from signalloom.operators import similarity as Y

    monkeypatch.setattr(Y, "FREQUENT", 100)
    rows = spark.range(0, 8000, 1, 8).select("id", F.explode(F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id").cast("string")))).alias("token"))
    codes = Y.written(token_codes(rows), "codes")
    told = coded(rows, codes)
    common = told.where("token = 'the'").groupBy(F.spark_partition_id()).count()
    assert common.count() >= 8 and common.agg(F.max("count")).first()[0] <= 1000
    assert told.count() == 16_000 and told.select("code").distinct().count() == 8001
    assert codes.orderBy("code").select("df").first()[0] == 1 and codes.orderBy(F.desc("code")).first()["token"] == "the"


@pytest.mark.parametrize("models", [1, 3])
def test_picks_beyond_the_first_leaders(spark, models):
    """Few leaders at first: copies and near copies fill them, so more are asked for until the picks are certain."""
    import brute

    rnd = random.Random(7)
    names = [f"m{i}" for i in range(models)]
    words = [f"word{i}" for i in range(9)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 7))) for _ in range(40)]
    rows = [(m, c, texts[min(int(rnd.paretovariate(0.5)), 39)], round(rnd.random(), 3)) for m in names for c in range(200)]
    df = spark.createDataFrame(rows, "model string, comment_id bigint, text string, relevance double")
    out = K.pick_distinct(df, 5, "model", "comment_id", "text", F.col("relevance"), names, depth=2)
    got = sorted((m, i, n + 1) for m, i, _, n in out)
    used, want = set(), []
    for m in names:
        kept = []
        for _, c, text in sorted(((s, c, t) for mm, c, t, s in rows if mm == m), reverse=True):
            a = brute.tokens(text)
            if c in used or len(kept) == 5 or any(a and b and len(a & b) / len(a | b) > 0.6 for b in kept):
                continue
            kept.append(a)
            used.add(c)
            want.append((m, c, len(kept)))
    assert got == sorted(want)
