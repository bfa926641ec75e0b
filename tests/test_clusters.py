import random
from datetime import datetime, timedelta

import brute
import pytest
from pyspark.sql import functions as F

from signalloom import fixed_values as V
from signalloom.operators.clusters import event_clusters, with_positions

SCHEMA = "title string, desc string, published_at timestamp, link string, source_name string, category string, n int"
FIRMS = [dict(id="acme", importance=90, match=["acme"]), dict(id="orb", importance=80, match=["orb", "orbit labs"])]


def run(spark, rows, threshold=0.34, entities=(), **options):
    """Founder per row and representative per founder, rows in list order."""
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    out = event_clusters(items, entities, threshold, order=(F.col("n"),), **options)
    founder = [r["cluster"] for r in out.items.orderBy("pos").collect()]
    reps = {r["cluster"]: r["pos"] for r in out.clusters.collect()}
    return founder, reps, out


def expect(rows, threshold=0.34, entities=()):
    names = ["title", "desc", "published_at", "link", "source_name", "category"]
    return brute.group([dict(zip(names, r)) for r in rows], threshold, entities)


def story(title, desc, hour, source, category="policy"):
    at = datetime(2026, 3, 1) + timedelta(hours=hour)
    return (title, desc, at, "https://n.example/" + title.replace(" ", "-"), source, category)


def test_two_outlets_one_dispute(spark):
    rows = [
        story("Daily Globe says Acme hid logs in copyright trial", "Publishers say Acme hid datasets in a copyright lawsuit.", 5, "A"),
        story("Acme may have slipped in copyright fight with newspapers", "Acme may be punished in the Globe copyright fight.", 4, "B"),
        story("Orb opens a cafe", "Coffee for staff at Orb.", 4, "C"),
    ]
    founder, reps, out = run(spark, rows, entities=FIRMS)
    assert founder == [0, 0, 2]
    assert reps == {0: 1, 2: 2}  # the earlier report represents the group
    counts = {r["cluster"]: r["source_count"] for r in out.clusters.collect()}
    assert counts == {0: 2, 2: 1}


def test_same_company_same_day_stays_apart(spark):
    rows = [
        story("Acme launches a family of engines", "Engines promise better mileage.", 9, "A", "product"),
        story("Acme is shutting down Comet, its browser", "Acme is sunsetting its browser.", 8, "A", "product"),
        story("Bug bounty for garden tools", "Details about the Acme bounty.", 7, "B", "general"),
        story("Helping teachers plan lessons", "Acme Academy visits schools.", 6, "B", "adoption"),
    ]
    assert run(spark, rows, entities=FIRMS)[0] == [0, 1, 2, 3]


def test_shared_object_merges_across_wording(spark):
    rows = [
        story("Acme is shutting down Comet as plans change", "Acme is sunsetting its browser after a year.", 2, "A", "product"),
        story("The Orb browser is already dead", "The experiment is over.", 3, "B", "product"),
    ]
    founder, reps, _ = run(spark, rows)
    assert founder == [0, 0] and reps == {0: 0}


def test_empty(spark):
    assert run(spark, [])[0] == []


def _random_rows(seed, n, copies):
    rnd = random.Random(seed)
    words = [f"word{k}" for k in range(60)] + ["browser", "launches", "sues", "acme", "orb", "New York", "Red Star"]
    base = [" ".join(rnd.choices(words, k=rnd.randint(2, 6))) for _ in range(25)]
    rows = []
    for i in range(n):
        title = rnd.choice(base[:4] if rnd.random() < copies else base)
        if rnd.random() < 0.3:
            title += " " + rnd.choice(words)
        desc = " ".join(rnd.choices(words, k=rnd.randint(0, 8)))
        at = datetime(2026, 3, 1) + timedelta(hours=rnd.choice([0, 0, 1, 5, 30, 60, 100, 200]) + rnd.randint(0, 3))
        rows.append((title, desc, at, f"l{i}", f"s{i % 5}", rnd.choice(["product", "policy", None])))
    return rows


@pytest.mark.parametrize("seed, options", [
    (1, {}),
    (2, {"slice_rows": 7}),  # representatives are carried over many slices
    (3, {"component_pairs": 5}),  # slices are cut into components
    (4, {"slice_rows": 20, "component_pairs": 5}),
])
def test_equals_sequential_reading(spark, seed, options):
    rows = _random_rows(seed, 90, copies=0.3)
    rows.sort(key=lambda r: r[2], reverse=True)
    founder, reps, _ = run(spark, rows, entities=FIRMS, **options)
    want, want_reps = expect(rows, entities=FIRMS)
    assert founder == want
    assert reps == want_reps


def test_a_third_are_copies_and_pairs_stay_linear(spark):
    """A burst of copies is chained, not compared pair by pair."""
    rows = []
    for i in range(300):
        at = datetime(2026, 3, 1) - timedelta(minutes=i)
        if i % 3 == 0:
            rows.append(("Red Star browser launches today", "same words every time", at, f"l{i}", "s", "product"))
        else:
            rows.append((f"alpha{i} beta{i} gamma{i}", f"delta{i} epsilon{i}", at, f"l{i}", "s", "product"))
    from signalloom.operators import clusters as K

    seen = []
    real = K.scored_pairs

    def counting(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    K.scored_pairs = counting
    try:
        founder, _, _ = run(spark, rows, slice_rows=30)
    finally:
        K.scored_pairs = real
    assert founder == expect(rows)[0]
    assert sum(seen) < 1500  # 100 copies have 4,950 pairs


def test_common_keys_are_salted(spark, monkeypatch):
    from signalloom.operators import clusters as K

    monkeypatch.setattr(K, "ROWS_PER_SALT", 4)
    rows = _random_rows(6, 60, copies=0.6)
    rows.sort(key=lambda r: r[2], reverse=True)
    assert run(spark, rows, entities=FIRMS, slice_rows=25)[0] == expect(rows, entities=FIRMS)[0]


@pytest.mark.parametrize("threshold", [0.12, 0.34, 0.6])
def test_near_dup_pairs_are_all_pairs_above_the_threshold(spark, threshold):
    """Against every pair scored, and with few candidates that are not above it."""
    from signalloom.operators import clusters as K

    rows = _random_rows(8, 120, copies=0.2)
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).select("*", F.col("n").cast("bigint").alias("pos"))
    features = K.written(K.item_features(items, FIRMS, len(rows)), "features")
    every = spark.range(len(rows)).toDF("i").join(spark.range(len(rows)).toDF("j"), F.col("i") > F.col("j"))
    every = K.scored_pairs(every, features, threshold, len(rows))
    want = {(r["i"], r["j"]): r["score"] for r in every.select("i", "j", "score").collect()}
    got = {(r["i"], r["j"]): r["score"] for r in K.near_dup_pairs(features, threshold, len(rows)).collect()}
    assert got == want and want


def test_one_exchange_of_pairs_by_each_end(spark):
    """Candidates are dealt out by i, where they are made distinct and meet i's features, and then by j."""
    from signalloom.operators import clusters as K

    rows = _random_rows(8, 40, copies=0.2)
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).select("*", F.col("n").cast("bigint").alias("pos"))
    features = K.written(K.item_features(items, FIRMS, len(rows)), "features")
    pairs = K.written(spark.range(50).selectExpr("id + 1 AS i", "id AS j").repartition(3), "pairs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = K.scored_pairs(pairs.repartition(8, "i").distinct(), features, 0.3, 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "ReusedExchange" not in line]
    assert len(exchanges) == 3  # the pairs by i, the features once for both ends, the pairs by j


def test_input_partitioning_does_not_matter(spark):
    rows = _random_rows(9, 60, copies=0.2)
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)
    a = event_clusters(items.repartition(1), (), 0.34).items.select("link", "cluster").collect()
    b = event_clusters(items.repartition(7), (), 0.34).items.select("link", "cluster").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_positions_are_dense(spark):
    df = spark.range(1000).repartition(7).withColumn("k", F.rand(3))
    out = with_positions(df, F.col("id").desc()).collect()
    assert sorted((r["pos"], r["id"]) for r in out) == [(i, 999 - i) for i in range(1000)]


def test_default_threshold():
    assert V.CLUSTER_THRESHOLD == 0.30 and V.PIPELINE_CLUSTER_THRESHOLD == 0.34


def test_pairs_do_not_travel(spark, monkeypatch):
    """F1 to F4: blocks meet where they were written; neither candidates nor features of a pair are shuffled."""
    from signalloom.operators import clusters as K

    plans, real = [], K.scores

    def seen(*args, **options):
        out = real(*args, **options)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(K, "scores", seen)
    monkeypatch.setattr(K, "ROWS_PER_SALT", 16)
    rows = _random_rows(8, 90, copies=0.2)
    rows.sort(key=lambda r: r[2], reverse=True)
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).select("*", F.col("n").cast("bigint").alias("pos"))
    features = K.written(K.item_features(items, FIRMS, len(rows)), "features")
    assert K.near_dup_pairs(features, 0.34, len(rows)).count()
    assert run(spark, rows, entities=FIRMS, slice_rows=40)[0] == expect(rows, entities=FIRMS)[0]
    assert len(plans) == 4 and not any("Exchange hashpartitioning" in p or "Exchange rangepartitioning" in p for p in plans)


def test_blocks_take_empty_and_long_rows(spark):
    """Rows without words, without category or action, and with more words than a chunk holds meetings."""
    from signalloom.operators import clusters as K

    long = " ".join(f"w{i}" for i in range(3000))
    at = datetime(2026, 3, 1)
    rows = [("", "", at, "l", "s", None), (None, None, at, "m", "s", "policy"), (long, long, at, "n", "s", None), (long, long, at, "o", "s", "policy"), ("a b", long, at, "p", "s", "policy")]
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).select("*", F.col("n").cast("bigint").alias("pos"))
    features = K.written(K.item_features(items, FIRMS, len(rows)), "features")
    every = spark.range(len(rows)).toDF("i").join(spark.range(len(rows)).toDF("j"), F.col("i") > F.col("j"))
    want = {(r["i"], r["j"], r["score"]) for r in K.scored_pairs(every, features, 0.2, len(rows)).collect()}
    assert {tuple(r) for r in K.near_dup_pairs(features, 0.2, len(rows)).collect()} == want and want


@pytest.mark.parametrize("threshold", [0.34, 0.7])
def test_few_pairs_are_scored(spark, monkeypatch, threshold):
    """F1 to F4: what cannot reach the threshold is sorted out by what titles, phrases, objects and rare words have in common."""
    import random

    import pyarrow as pa

    from signalloom.operators import clusters as K
    from signalloom.operators import tiles

    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    rows = [(say(9), say(40), datetime(2026, 3, 1 + i % 20), f"l{i}", "s", rng.choice(["policy", None])) for i in range(150)]
    rows += [(rows[i][0], rows[i][1] + " more", *rows[i][2:]) for i in range(30)]
    rows += [("Acme unveils Atlas chip", say(9), datetime(2026, 3, 1 + i), f"m{i}", "s", "policy") for i in range(4)]
    items = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA).select("*", F.col("n").cast("bigint").alias("pos"))
    features = K.written(K.item_features(items, FIRMS, len(rows)), "features")
    x = tiles.Block(pa.py_buffer(K.packed(features, len(rows), len(rows)).first()["data"]), len(rows))
    scored, real = [], tiles._score
    monkeypatch.setattr(tiles, "_score", lambda content, *more: scored.append(content.size) or real(content, *more))
    found = {(i, j, s) for b in tiles.compared(x, x, threshold, False) for i, j, s in zip(*(b.column(c).to_pylist() for c in ("i", "j", "score")))}
    every = spark.range(len(rows)).toDF("i").join(spark.range(len(rows)).toDF("j"), F.col("i") > F.col("j"))
    assert found == {(r["i"], r["j"], r["score"]) for r in K.scored_pairs(every, features, threshold, len(rows)).collect()}
    assert len(found) >= 30 and sum(scored) < len(rows) ** 2 / 10
