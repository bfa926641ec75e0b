import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from signalloom.llm import decontaminate as D


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(n) for n in (15, 18, 25, 30, 31, 38, 45, 59)]
    docs = [say(rng.randint(1, 400)) for _ in range(150)]
    planted = set()
    for k in range(24):
        d, i = 2 * k, k % len(items)
        at = rng.randint(0, len(docs[d]))
        piece = list(items[i])
        if k >= 8:  # a paraphrase: every eighth word is another one
            for j in range(3, len(piece) - len(piece) // 4, 8):
                piece[j] = rng.choice(words)
        docs[d][at:at] = [w.upper() if k % 3 == 0 else w + "," for w in piece]
        planted.add((d, i))
    return [" ".join(d) for d in docs], [" ".join(i) for i in items], planted


def test_finds_planted_items_and_nothing_else(spark):
    texts, items, planted = corpus()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (0, texts[0], "x"), (None, texts[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string").repartition(3)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "too short"), (92, "")], "item_id long, text string")
    found = D.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted | {(None, 1)}
    assert sum(r["doc_id"] == 0 for r in found) == 2
    clean = D.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {r[0] for r in rows if r[0] is not None} - {d for d, _ in planted}
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def diluted():
    """Leaks with words put in between or with a third of their words missing, among texts without any; what a search over all windows finds."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(n) for n in (20, 24, 30, 40, 60, 60, 100, 100, 160)]
    docs = [say(rng.randint(20, 300)) for _ in range(120)]
    for k in range(54):
        i = k % len(items)
        if k % 3 == 0:  # a filler after each word
            piece = [w for x in items[i] for w in (x, rng.choice(words))]
        elif k % 3 == 1:  # two thirds of the words, the answer among them, spread over 5/4 of the length
            cut = len(items[i]) // 4
            body = sorted(rng.sample(range(len(items[i]) - cut), -(-2 * len(items[i]) // 3) - cut))
            piece = [items[i][j] for j in body] + items[i][-cut:]
            for _ in range(5 * len(items[i]) // 4 - len(piece)):
                piece.insert(rng.randint(0, len(piece)), rng.choice(words))
        else:
            piece = [w for j, x in enumerate(items[i]) for w in ([x, rng.choice(words)] if j % 2 else [x])]
        at = rng.randint(0, len(docs[k]))
        docs[k][at:at] = piece
    want = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            tail = max(3, len(item) // 4)
            for low in range(0, max(1, len(doc) - 2 * len(item)) + 12, 12):
                near = doc[low : low + 2 * len(item) + 12]
                if len(set(near) & set(item)) < 0.5 * len(item):
                    continue
                common = longest_common(item, near) / len(item)
                if common >= 0.8 or common >= 0.6 and longest_common(item[-tail:], near) >= 0.6 * tail:
                    want.add((d, i))
    return [" ".join(d) for d in docs], [" ".join(i) for i in items], want


def test_recall_with_words_put_in_between(spark):
    texts, items, want = diluted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for rows in (20_000, 40):  # the latent space of all rows, and of a third
        found = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench, fit_rows=rows).collect()}
        print(rows, len(want), len(found & want), len(found - want), sorted(want - found))
        assert len(want) >= 50 and len(found & want) >= 0.95 * len(want)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    """Many items go in blocks; the words of the documents are counted once for all of them."""
    texts, items, planted = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    calls = []
    real = D.counted
    monkeypatch.setattr(D, "counted", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(D, "_ITEMS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()} == planted
    assert len(calls) == 1


def test_the_latent_space_is_that_of_all_rows(spark):
    """More rows than were sampled before; the sums are those of a plain program over every word of every row."""
    import numpy as np
    import pyarrow as pa

    n, common = 30_000, "one two three"
    docs = spark.range(n).select(F.when(F.col("id") % 1000 == 7, F.lit(None)).otherwise(F.concat(F.lit(common + " w"), F.col("id"), F.lit(" x"))).alias("text"))
    corpus = D.counted(docs.repartition(5))
    assert corpus.rows.count() == n
    words, begin = D._words(pa.array([r["text"] for r in docs.collect()]))
    starts, _ = D._blocks(begin)
    signs = D._signs(words, starts).astype(int) * 2 - 1
    want = np.zeros((D._TERMS, D._DIRECTIONS))
    np.add.at(want, D._term(words), np.repeat(signs, np.diff(np.append(starts, len(words))), axis=0))
    assert corpus.blocks == len(starts) == n - n // 1000
    assert (corpus.signs == want).all()
    held = np.unique(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words)))) * D._TERMS + D._term(words))
    assert (corpus.counts == np.bincount(held % D._TERMS, minlength=D._TERMS)).all()


def test_every_row_is_fitted_on_unless_asked_otherwise(spark, monkeypatch):
    """A search with no options fits on the rows it searches, however many there are."""
    texts, items, _ = corpus()
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(21_000)], "doc_id long, text string").repartition(4)
    seen, real = [], D.fit
    monkeypatch.setattr(D, "fit", lambda c, i: seen.append(c) or real(c, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    D.mark(docs, bench)
    assert seen[0].rows.count() == 21_000


def test_the_stage_fits_on_all_its_documents(spark, tmp_path, monkeypatch):
    texts, items, _ = corpus()
    docs = spark.range(21_000).select(F.concat(F.lit(texts[0][:40] + " w"), F.col("id")).alias("text"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, real = [], D.fit
    monkeypatch.setattr(D, "fit", lambda c, i: seen.append(c) or real(c, i))
    P.decontamination(spark, docs, str(tmp_path))
    assert seen[0].rows.count() == 21_000


def test_common_subsequence_in_bits():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randint(0, 9) for _ in range(rng.randint(5, 40))]
        b = [rng.randint(0, 9) for _ in range(rng.randint(0, 60))]
        item = D._Item(0, np.array(a, np.uint64))
        assert item.common(b) == longest_common(a, b)
        assert item.common(b, item.answer_from) == longest_common(a[item.answer_from :], b)


@pytest.mark.parametrize("with_extra", [False, True])
def test_every_stage_takes_edge_cases(spark, tmp_path, with_extra):
    texts, items, _ = corpus()
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "s1", 1), (None, texts[5] + " more", None, None, None), (500, None, "de", "s0", 0), (501, "", None, "s0", 0), (502, "w" * 100_000, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    if with_extra:
        for c in ("_row", "row", "th", "node", "uid", "leaks", "shard_x", "_copies", "k"):
            docs = docs.withColumn(c, F.lit(c))
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, now, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert {"shard", "shard_bytes", "oversize"} <= set(now.columns)
    assert 0 < now.count() <= docs.count()


def test_one_document_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    rows = [(4, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (7, "all by itself here we go"), (7, "all by itself here we go"), (None, " ".join(base))]
    out = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["2", "7"]


def test_items_of_equal_reach_are_neighbours():
    """So that the bound of many items is read as one piece of the counts, whatever the order they are given in."""
    import numpy as np

    from signalloom.llm import decontaminate as D

    sizes = [90, 8, 40, 29, 60, 12, 35]
    items = [D._Item(k, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k, n in enumerate(sizes)]
    searcher = D.Searcher(np.ones((D._TERMS, 2), np.float32), np.ones(D._TERMS, np.float32), items, [np.ones((-(-n // 12), 2), np.float32) for n in sizes], 0.3, 0.8, 0.6)
    for _, chosen, _, _, held in searcher.groups:
        assert held.tolist() == sorted(held.tolist()) == [sizes[k] for k in chosen]
