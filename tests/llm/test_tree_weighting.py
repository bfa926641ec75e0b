import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from signalloom.llm import tree_weighting as T


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


def brute(train, texts, depth):
    """Recursive context-tree weighting with dictionaries."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def decisions(s):
        yield 0, int(s == 256)
        if s < 256:
            for k in range(8):
                yield (256 + s) >> (8 - k), s >> (7 - k) & 1

    def runs(text):
        s = [256] * depth + list(text.encode()) + [256]
        for i in range(depth, len(s)):
            yield tuple(reversed(s[i - depth : i])), s[i]  # nearest first

    for t in train:
        for c, s in runs(t):
            for node, bit in decisions(s):
                for d in range(depth + 1):
                    counts[d][c[:d], node][bit] += 1
    children = [defaultdict(list) for _ in range(depth + 1)]
    for d in range(1, depth + 1):
        for c, n in counts[d]:
            children[d - 1][c[:-1], n].append((c, n))
    weighted = [{} for _ in range(depth + 1)]
    for d in range(depth, -1, -1):
        for key, (a, b) in counts[d].items():
            own = log_kt(a, b)
            if d < depth:
                below = sum(weighted[d + 1][x] for x in children[d][key])
                top = max(own, below)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            weighted[d][key] = own

    def one(c, node):
        mixed, left = 0.0, 1.0
        last = None
        for d in range(depth + 1):
            key = c[:d], node
            if key not in counts[d]:
                break
            a, b = counts[d][key]
            w = 1.0 if d == depth else math.exp(math.log(0.5) + log_kt(a, b) - weighted[d][key])
            last = (b + 0.5) / (a + b + 1)
            mixed, left = mixed + left * w * last, left * (1 - w)
        return 0.5 if last is None else mixed / (1 - left) if left < 1 - 1e-9 else last

    out = []
    for t in texts:
        out.append(sum(math.log10(one(c, n) if b else 1 - one(c, n)) for c, s in runs(t) for n, b in decisions(s)))
    return out


def base(train, text):
    words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)) + [None]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, len(words(text)), sum(c[w] > 0 for w in words(text)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text))


@pytest.mark.parametrize("depth,nodes,frequent", [(2, 1 << 20, 1 << 19), (5, 1 << 20, 8)])
def test_equals_recursive_version(spark, depth, nodes, frequent):
    rng = random.Random(9)
    texts = [None, "", "A", "é\n"] + ["".join(rng.choice("abAB é\n") for _ in range(rng.randint(1, 200))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    out = {r["doc_id"]: r for r in T.score(docs, ~T.held_out(F.col("doc_id")), depth, nodes, frequent).collect()}
    want = brute(train, [t or "" for t in texts], depth)
    for i, t in enumerate(texts):
        n, tokens, known, b = base(train, t or "")
        r = out[i]
        assert (r["train_tokens"], r["n_tokens"], r["n_known"]) == (n, tokens, known)
        assert r["base_score"] == pytest.approx(b) and r["score"] == pytest.approx(want[i], rel=1e-6)


def test_scores_do_not_depend_on_what_tasks_hold(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = F.col("doc_id") % 3 > 0
    whole = {r["doc_id"]: r["score"] for r in T.score(docs, train, 3).collect()}
    for nodes, frequent in ((0, 0), (40, 8), (400, 50)):
        out = {r["doc_id"]: r["score"] for r in T.score(docs, train, 3, nodes=nodes, frequent=frequent).collect()}
        assert out.keys() == whole.keys() and all(out[i] == pytest.approx(whole[i], rel=1e-9) for i in whole)
    want = brute([t for i, t in enumerate(texts) if i % 3], texts, 3)
    assert all(whole[i] == pytest.approx(w, rel=1e-4) for i, w in enumerate(want))  # a context seen once is a leaf


def test_empty_tables(spark):
    docs = spark.createDataFrame([(i, "abc abd " * 20) for i in range(20)], "doc_id long, text string")
    assert T.score(docs.limit(0), F.lit(True)).count() == 0
    blank = T.score(docs, F.lit(False)).first()
    assert blank["score"] == pytest.approx(-(160 * 9 + 1) * math.log10(2)) and blank["n_known"] == 0
