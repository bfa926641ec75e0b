import random
import re

import numpy as np
import pytest

from signalloom.llm import jaccard_join as J
from signalloom.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return sorted(((d, len(sets[i]), groups.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "a b c d"), (8, "A b  c d")]
    for size in (30, 120, 400, 1500):
        text = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            near = list(text)
            for _ in range(edits * size // 300 + edits):
                near[rng.randrange(size)] = word()
            rows.append((len(rows) + 10, " ".join(near)))
    passage = " ".join(word() for _ in range(50))
    rows += [(len(rows) + 10 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(12)]
    return rows + [(20, rows[10][1]), (9, "a b c d")]


@pytest.mark.parametrize("k,percent,block", [(4, 85, 4096), (5, 80, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(J, "_BLOCK", block)  # a small block: crowded tiles are cut
    rows = corpus()
    out = J.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, k, percent)


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (None, "q r s t u"), (2, "A b c d e")]
    out = J.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, 2, 2), (3, 2, 2), (None, 2, None), (2, 2, 2)], key=str)
    assert J.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # linked by a row without an id only
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v"), (None, "a b c d e f g h i j k l m n o p q r s t u v w"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x"), (None, None)]
    out = J.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 90).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 4, 90)


def test_texts_under_one_id_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, "other words " * 5), (2, text + " z"), (3, "other words " * 5 + "other z")]
    out = J.link(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, component int"), 4, 70).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 4, 70)
    long = [(1, "x " + text), (1, "q w e r t y u i o p a s d f g h"), (2, "x " + text), (3, "q w e r t y u i o p a s d f g h j")]
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in J.link(spark.createDataFrame(long, "doc_id long, text string"), 4, 85).collect()}
    assert out == {(1, 38): 1, (1, 13): 1, (2, 38): 1, (3, 14): 1}


@pytest.mark.parametrize("block", [4096, 16])
def test_near_copies_below_the_threshold_emit_rows_in_proportion(spark, monkeypatch, block):
    """All pairs of a group come near the threshold and fail: a class asks once a tile, no pairs are written."""
    monkeypatch.setattr(J, "_BLOCK", block)
    sizes = {}
    real = J.written

    def counting(df, label):
        out = real(df, label)
        sizes.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(J, "written", counting)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(120):
        text = list(base)
        for at in rng.sample(range(0, 300, 5), 7):  # seven of sixty places: two texts differ in about twelve of 297 shingles a place
            text[at] = f"x{n}-{at}"
        rows.append((n, " ".join(text)))
    out = J.link(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 4, 80)
    tiles = max(1, -(-120 // block))
    assert max(sizes["jaccard-asking"]) <= 24 * 120 * tiles and max(sizes["jaccard-links"]) < 24 * 120 * tiles


def test_signature_bounds_the_difference():
    rng = np.random.RandomState(1)
    for n in (1, 40, 700):
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.append(a[n // 10 :], rng.randint(0, 2**62, n // 7).astype(np.uint64)))
        x, y = (J._signature(u, 85, 8) for u in (a, b))
        words = min(len(x), len(y)) // 8
        assert np.bitwise_count(J._folded([x], words) ^ J._folded([y], words)).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 150)]
    random.Random(1).shuffle(links)
    out = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 130)} == {100} and out[200] == 150
