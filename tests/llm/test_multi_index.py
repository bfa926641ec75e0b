import math

import numpy as np
import pytest

from signalloom.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine):
    """All pairs of rows, then the least id of what hangs together."""
    usable, label = {}, list(range(len(rows)))
    for i, (_, x, group) in enumerate(rows):
        if x is not None and group is not None and None not in x and all(map(math.isfinite, x)) and any(x):
            v = np.array(x, np.float32).astype(float)
            usable[i] = (group, v / np.sqrt((v**2).sum()))
    links = [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (g, v) in usable.items():
        for j, (h, w) in usable.items():
            if j < i and g == h and len(v) == len(w) and v @ w >= cosine:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    least = {}
    for i, (name, _, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((n, links[i], least.get(find(i)), n is not None and n == least.get(find(i))) for i, (n, _, _) in enumerate(rows)), key=str)


def near(rng, x, cosine):
    """A vector at the given cosine to ``x``, in a random direction."""
    d = rng.normal(size=len(x))
    d -= d @ x / (x @ x) * x
    return x / np.linalg.norm(x) * cosine + d / np.linalg.norm(d) * math.sqrt(1 - cosine**2)


def corpus(dim=16, n=150):
    rng = np.random.RandomState(3)
    rows = []
    for i in range(n):
        x = rng.normal(size=dim)
        rows.append((1000 - i, x, i % 3))
        for k in range(i % 4):
            rows.append((2000 + 10 * i + k, near(rng, x, rng.uniform(0.975, 0.999)) * rng.uniform(0.1, 9), i % 3))
    hot = rng.normal(size=dim)
    rows += [(5000 + i, near(rng, hot, 0.993), 1) for i in range(120)]
    rows = [(i, [float(v) for v in x], g) for i, x, g in rows]
    copies = [(6000 + i, rows[5][1], rows[5][2]) for i in range(6)] + [(6100, rows[5][1], 2 - rows[5][2])]
    odd = [
        (1, None, 0), (2, [0.0] * dim, 0), (3, [0.0] * dim, 0), (4, [None] + [1.0] * (dim - 1), 0), (5, [math.nan] * dim, 0), (6, [math.inf] * dim, 0),
        (7, rows[0][1], None), (8, rows[0][1], None), (None, rows[0][1], rows[0][2]), (rows[1][0], rows[1][1], rows[1][2]),
        (9, [1.0, 2.0], 0), (10, [1.0, 2.01], 0), (11, [3.0], 0), (12, [], 0), (None, [5.0] * dim, 0),
    ]
    return rows + copies + odd


@pytest.mark.parametrize("recall,block", [(1.0, 2048), (1.0, 16), (0.9999, 2048)])
def test_links_equal_all_pairs(spark, monkeypatch, recall, block):
    monkeypatch.setattr(M, "_BLOCK", block)  # small blocks: crowded cells are dealt out
    rows = corpus()
    out = M.link(spark.createDataFrame(rows, SCHEMA).repartition(5), recall=recall).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 0.98)


def test_vectors_in_double_precision_and_other_columns(spark):
    rows = [(1, [1.0, 0.0, 1e-9], "a", 7), (2, [1e200, 0.0, 0.0], "a", 8), (3, [-1.0, 0.0, 0.0], "a", 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node long")
    out = sorted(map(tuple, M.link(df.withColumnRenamed("node", "raw")).collect()))
    assert out == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty_table_and_nothing_to_compare(spark):
    assert M.link(spark.createDataFrame([], SCHEMA)).count() == 0
    out = M.link(spark.createDataFrame([(4, None, 1), (None, [1.0], None)], SCHEMA)).collect()
    assert sorted(map(tuple, out), key=str) == [(4, 0, 4, True), (None, 0, None, False)]


def test_excess_is_a_lower_bound():
    rng = np.random.RandomState(2)
    x = M._unit(rng.normal(size=(300, 12)))
    grid = M.Grid(12, M._k_means(x[:, :6], 7), M._k_means(x[:, 6:], 5))
    cell, a, b = grid.excess(x)
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    bound = a[:, cell // 5] + b[:, cell % 5]
    assert (bound <= far + 1e-12).all() and (bound > 0).any()


def test_recall_against_brute_force(spark):
    """The given embeddings, every fifth with a few vectors near the threshold: at least 0.9 of all links are found, and none else."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"]), r["label"]) for r in given.select("vec_id", "embedding", "label").collect()]
    rng = np.random.RandomState(9)
    rows += [(100_000 + 10 * i + k, near(rng, x, rng.uniform(0.978, 0.995)), g) for i, x, g in rows[::5] for k in range(3)]
    rows = [(i, [float(c) for c in x], g) for i, x, g in rows]
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = M._unit(np.array([r[1] for r in rows], np.float32).astype(float))
    linked = (x @ x.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    want = dict(zip(ids.tolist(), linked.sum(1).tolist()))
    got = {r["vec_id"]: r["n_links"] for r in M.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(want.values()) > 1000 and all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())
