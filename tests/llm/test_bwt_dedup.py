import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from signalloom.llm import bwt_dedup as B


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(45), say(120)
    texts = [None, "", "short", "a" * 500, "ab" * 200 + say(30) + "ab" * 150, passage, passage]
    texts += [say(20) + passage + say(25) for _ in range(12)]
    for _ in range(25):
        w = base.split()
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return texts + [texts[8], say(40) * 2, passage[:199], passage[:200], say(400)]


@pytest.mark.parametrize("crowd,lot,shard", [(4096, 1 << 20, 1 << 18), (4096, 3000, 900), (2, 1 << 20, 1 << 18)])
def test_equals_brute_force(spark, crowd, lot, shard):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in B.digests(docs, 200, crowd=crowd, lot_bytes=lot, shard_bytes=shard).collect()}
    for i, want in enumerate(brute(texts, 200)):
        assert got[i] == want, i


def test_rows_without_id_and_repeated_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(None, text), (5, text[:230]), (5, text[:230]), (5, "other"), (None, None)]
    out = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in B.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([("None", 260, 230), ("5", 230, 230), ("5", 230, 230), ("5", 5, 0), ("None", 0, 0)])
    assert B.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text, "x", 3, "y"), (2, "more " + text, "x", 3, "y")]
    out = B.digests(spark.createDataFrame(rows, "doc_id long, text string, anchor string, n_bytes int, th string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, len(text)), (2, len(text))]


def test_merge_gives_common_prefixes():
    strings = [b"banana", b"ananas", b"bandana"]
    for shard in (1, 100):
        flags = B.repeated_windows(strings, np.array([4, 4, 5]), np.ones(3), 3, shard)
        every = [s[i : i + 3] for s in strings for i in range(len(s) - 2)]
        assert [f.tolist() for f in flags] == [[every.count(s[i : i + 3]) > 1 for i in range(len(s) - 2)] for s in strings]
