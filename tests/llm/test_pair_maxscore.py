import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import pair_maxscore as P

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    n, length = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for d, t in held:
            if not t:
                continue
            m = 100 - 90 + 90 * len(t) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in own if x in t)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["Été", "straße", "日本", "a_b", "x-y", "it's"]
    pick = lambda: words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rng.choice([3, 20, 60, 400])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(7, docs[8][1]), (None, docs[7][1]), (None, docs[9][1]), (9000, None), (9001, ""), (9002, " .,;\n")]
    items = [(i, " ".join(pick() for _ in range(rng.choice([1, 4, 25])))) for i in range(40)]
    items += [(3, "w299 w298"), (100, docs[7][1]), (100, docs[7][1]), (101, None), (102, "-- !!"), (103, "nowhere"), (None, "w1 w250 W250")]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    return sorted(map(tuple, P.rank(d, q, **more).collect()), key=str)


@pytest.mark.parametrize("rare,part,block", [(64, 4096, 1024), (8, 37, 7), (1, 50, 1024), (10**9, 4096, 3)])
def test_ranks_equal_all_scores(spark, monkeypatch, rare, part, block):
    monkeypatch.setattr(P, "_RARE", rare)
    monkeypatch.setattr(P, "_PART_ROWS", part)
    monkeypatch.setattr(P, "_BLOCK_ITEMS", block)
    docs, items = corpus()
    assert run(spark, docs, items) == brute(docs, items)


def test_fewer_documents_than_places_and_empty_tables(spark):
    docs = [(1, "alpha beta"), (2, "beta"), (3, "gamma")]
    assert run(spark, docs, [(5, "Alpha BETA delta")]) == brute(docs, [(5, "Alpha BETA delta")])
    assert run(spark, docs, [(5, "Alpha BETA")], k=1) == brute(docs, [(5, "alpha beta")], 1)
    for d, q in (([], [(1, "a")]), (docs, []), ([(1, None)], [(1, "a")]), (docs, [(1, None), (2, "zzz")])):
        assert run(spark, d, q) == []


def test_clashing_names_and_long_texts(spark):
    text = "alpha " * 300_000 + "beta " * 1000 + "ω" * 1_000_000
    d = spark.createDataFrame([(1, text, 5, "x"), (2, "beta", 6, "y")], "doc_id long, text string, item_id long, rank string")
    q = spark.createDataFrame([(1, "beta", 9), (2, "ω" * 1_000_000, 8)], "item_id long, text string, doc_id long")
    assert sorted(map(tuple, P.rank(d, q).collect()), key=str) == brute([(1, text), (2, "beta")], [(1, "beta"), (2, "ω" * 1_000_000)])


def test_pairs_tighten_the_bounds():
    """With pair lists fewer documents are scored than with single maxima, and none that belongs to the answer is passed over."""
    docs, items = corpus(1500, 3)
    held = [(i, terms(t)) for i, (_, t) in enumerate(docs)]
    names = sorted({x for _, q in items for x in terms(q)})
    column = pa.array([" ".join(names)])
    code = dict(zip(names, P._terms(column)[0].tolist()))
    place = np.array(sorted(code.values()))
    df = {x: sum(x in t for _, t in held) for x in names}
    weight = {code[x]: P._weight(len(held), d) if d else 0 for x, d in df.items()}
    freq = {code[x]: d for x, d in df.items()}
    own = [np.searchsorted(place, sorted({code[x] for x in terms(q)})) for _, q in items]
    block = P.Block([i for i, _ in items], own, place, np.array([weight[t] for t in place.tolist()]), np.array([freq[t] * 16 <= len(held) for t in place.tolist()]), len(held), sum(len(t) for _, t in held))
    bitmap = np.ones(P._BITS, bool)
    forward = list(P._counted(bitmap)([pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([t for _, t in docs])], names=["doc_id", "text"])]))
    part = P.Part(next(P._inverted(block)(forward)), 0)
    with_pairs = without = 0
    for item in block.own:
        lists = part.lists(item)
        if not len(lists):
            continue
        everyone = np.arange(len(docs), dtype=np.int32)
        full = part.scores(everyone, lists)
        least = max(int(np.sort(full)[-10]), 1)
        kept = P.candidates(part, lists, least, block.rare)
        assert set(np.flatnonzero(full >= least)) <= set(kept.tolist())
        order = lists[np.argsort(-part.most[lists], kind="stable")]
        rest = np.cumsum(part.most[order][::-1])[::-1]
        single = set().union(*[part.list(i)[0].tolist() for i in order[rest >= least]])
        with_pairs, without = with_pairs + len(kept), without + len(single)
    assert with_pairs < 0.5 * without


def test_a_part_of_the_index_is_a_small_row():
    """A pair keeps its leading documents and greatest sum, however many documents hold it; a part has 512 documents."""
    docs = 3000
    words = np.array([5, 9], "<i8")
    forward = pa.record_batch(
        [pa.array(range(docs), pa.int64()), pa.array([2 + i % 7 for i in range(docs)], pa.int64()),
         pa.array([words.tobytes()] * docs, pa.binary()), pa.array([np.array([1 + i % 3, 1], "<i4").tobytes() for i in range(docs)], pa.binary())],
        names=["doc_id", "n", "terms", "counts"],
    )
    block = P.Block([1], [np.arange(2)], words, np.array([700, 900]), np.ones(2, bool), docs, 5 * docs)
    parts = list(P._inverted(block, 10)(iter([forward])))
    assert sum(len(P.Part(p, 0).docs) for p in parts) == docs and len(parts) == 6
    for p in parts:
        part = P.Part(p, 0)
        assert len(part.pair_rows) == 10 and part.pair_at.tolist() == [0, 10]
        rows = np.arange(len(part.docs))
        score = part.scores(rows, part.lists(np.arange(2)))
        assert part.pair_most.tolist() == [score.max()]
        assert part.pair_rows.tolist() == np.lexsort((rows, -score))[:10].tolist()
