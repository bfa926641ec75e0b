from collections import defaultdict

from pyspark.sql import functions as F

from signalloom.llm import mixture as M
from signalloom.llm import sharding as S


def fill(budget, children):
    """children: name -> (weight, capacity); shares by repeated filling."""
    got, left, rest = {}, dict(children), budget
    while left:
        level = rest / sum(w for w, _ in left.values())
        full = {n for n, (w, c) in left.items() if c <= level * w * (1 + 1e-12)}
        if not full:
            return got | {n: level * w for n, (w, _) in left.items()}
        for n in full:
            got[n] = left[n][1]
            rest -= left.pop(n)[1]
    return got


def test_shortages_go_to_siblings_before_ancestors(spark):
    supply = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 30), ("b", "z", 20), ("c", "x", 5000)]
    weights = {"d": {"a": 1.0, "b": 2.0, "c": 1.0}, "s": {"x": 3.0}}
    got = {(r["d"], r["s"]): r["_got"] for r in M.allocate(spark.createDataFrame(supply, "d string, s string, _capacity long"), ["d", "s"], weights, F.lit(400)).collect()}
    top = fill(400, {"a": (1, 1010), "b": (2, 50), "c": (1, 5000)})
    assert top == {"a": 175.0, "b": 50, "c": 175.0}
    want = {("b", "x"): 30, ("b", "z"): 20, ("c", "x"): 175} | {("a", n): int(v) for n, v in fill(175, {"x": (3, 10), "y": (1, 1000)}).items()}
    assert got == want and want["a", "x"] == 10 and want["a", "y"] == 165


def test_prefix_of_the_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(M, "_EDGE_ROWS", 1)  # several passes of the descent
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, "s") for i in range(400)] + [(1, "w " * 3, "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, copies string")
    out = M.mix(docs, {"lang": F.col("lang")}, {"lang": {"en": 2.0}}, share=0.7, epochs=2).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["lang"]].append(r)
    total = sum(r["n_tokens"] for r in out)
    assert 0.7 * total - 20 <= sum(r["n_tokens"] * r["copies"] for r in out) <= 0.7 * total
    for leaf in by.values():
        full = min(r["copies"] for r in leaf)
        order = spark.createDataFrame([(r["doc_id"], full) for r in leaf], "k long, e long").select(M.place_in_order(7, F.col("e"), F.col("k"))).collect()
        chosen = [c for _, c in sorted((o[0], r["copies"] - full) for o, r in zip(order, leaf))]
        assert chosen == sorted(chosen, reverse=True) and set(chosen) <= {0, 1}  # a prefix
    taken = M.take(docs, {"lang": F.col("lang")}, {}, share=1.0, epochs=1)
    assert taken.columns == docs.columns and taken.count() == len(rows)
    assert M.take(docs.limit(0), {"lang": F.col("lang")}, {}).count() == 0


def test_no_document_is_read_more_often_than_allowed(spark, monkeypatch):
    rows = [(i, "w " * (i % 3), "en") for i in range(60)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, n_tokens int, copies string")
    for most in (100_000, 0):  # with the plan in every task, and salted
        monkeypatch.setattr(M, "_MOST_LEAVES", most)
        out = M.mix(docs, {"lang": F.col("lang")}, {}, share=2.0, epochs=2).collect()
        assert {r["copies"] for r in out} == {2}
        assert M.take(docs, {"lang": F.col("lang")}, {}, share=2.0, epochs=2).count() == 120
        half = {r["doc_id"]: r["copies"] for r in M.mix(docs, {"lang": F.col("lang")}, {}, share=0.5, epochs=2).collect()}
        assert len(half) == 60 and set(half.values()) <= {0, 1}


def test_rows_of_a_leaf_are_not_gathered(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    plan = M.take(docs, {"lang": F.col("lang")}, {}, share=0.5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_only_large_buckets_split(spark):
    rows = [(i, "x" * (i % 50), "old") for i in range(500)] + [(1000, "y" * 900, "old"), (None, None, "old")] + [(2000, "z" * 200, "old")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    limit = 700
    out = S.assign(docs, limit)
    assert out.columns == ["doc_id", "text", "shard", "shard_bytes", "oversize"] and out.count() == len(rows)
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", S.hash_bits(F.col("doc_id")).alias("h")).distinct().collect()}
    size = defaultdict(int)
    for d, t, _ in rows:
        for depth in range(61):
            size[depth, h[d] >> (60 - depth)] += len(t or "")
    for r in out.collect():
        bits = [(k, h[r["doc_id"]] >> (60 - k)) for k in range(61)]
        depth, prefix = next((b for b in bits if size[b] <= limit), bits[60])
        assert r["shard"] == (f"{prefix:b}".zfill(depth) if depth else "") and r["shard_bytes"] == size[depth, prefix]
        assert r["oversize"] == (r["doc_id"] in (1000, 2000))
    assert S.assign(docs.limit(0), limit).count() == 0
    assert {r["shard"] for r in S.assign(docs, 10**9).collect()} == {""}
