import math

import numpy as np
import pytest

from signalloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    x = np.unique(np.floor(256 * np.array(vectors, np.float32).astype(float)), axis=0)
    n, sums = len(x), x.sum(0)
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, sums, e[::-1], v[:, ::-1]


def compare(out, vectors, keep=4):
    """Rows of the operator against an eigenvalue decomposition; signs of components are free."""
    n, sums, e, v = brute(list(vectors.values()))
    by = {}
    for r in out:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, keep + 1))
    for k, rows in by.items():
        assert rows.keys() == vectors.keys()
        want = {i: float((np.floor(256 * np.array(x, np.float32).astype(float)) - sums / n) @ v[:, k - 1] / math.sqrt(e[k - 1])) for i, x in vectors.items()}
        sign = np.sign(sum(want[i] * rows[i]["whitened"] for i in want))
        for i, r in rows.items():
            x = [int(math.floor(256 * c)) for c in np.array(vectors[i], np.float32).astype(float)]
            assert r["n"] == n and r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
            assert abs(sign * r["whitened"] - want[i]) < 1e-7
            assert abs(r["explained"] - e[k - 1] / e.sum()) < 1e-10 and r["identity_error"] < 1e-9


def test_components_equal_an_eigenvalue_decomposition(spark):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(300, 12)) @ np.diag(2.0 ** -np.arange(12)) @ rng.normal(size=(12, 12))
    vectors = {i: [float(c) for c in row] for i, row in enumerate(x)}
    vectors |= {1000 + i: vectors[0] for i in range(40)}  # copies count once
    df = spark.createDataFrame(list(vectors.items()), SCHEMA).repartition(7)
    compare(W.whiten(df).collect(), vectors)


def test_dependent_and_constant_columns(spark):
    rng = np.random.RandomState(5)
    x = rng.randint(-500, 500, (200, 3)) / 256.0
    x = np.column_stack([x[:, 0], x[:, 0] + x[:, 1], np.full(200, 3.0), x[:, 1], x[:, 2] * 1000, -x[:, 0]])
    vectors = {i: [float(c) for c in row] for i, row in enumerate(x)}
    compare(W.whiten(spark.createDataFrame(list(vectors.items()), SCHEMA)).collect(), vectors, keep=3)


def test_ill_conditioned_columns(spark):
    """Columns that nearly depend on each other: the Gram matrix's condition is the square of the list's."""
    rng = np.random.RandomState(6)
    a = rng.randint(-(1 << 22), 1 << 22, 400).astype(float)
    x = np.column_stack([a, a + rng.randint(0, 2, 400), rng.randint(0, 2, 400)]) / 256.0
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    rows = W.whiten(df, 3).collect()
    y = np.unique(np.floor(256 * x), axis=0)
    size = np.linalg.svd(y - y.mean(0), compute_uv=False)
    for k in (1, 2, 3):
        got = next(r["explained"] for r in rows if r["component"] == k)
        assert abs(got / (size[k - 1] ** 2 / (size**2).sum()) - 1) < 1e-6
    assert rows[0]["identity_error"] < 1e-6


def test_edge_cases(spark):
    odd = [(1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf, 1.0]), (5, [1.0]), (6, [1.0, 2.0, 3.0])]
    some = [(None, [0.5, 0.25]), (8, [0.5, 0.25]), (9, [-0.5, 0.125]), (9, [1.0, -3.0])]
    out = W.whiten(spark.createDataFrame(odd + some, SCHEMA)).collect()
    assert {(r["vec_id"], r["component"]) for r in out} == {(i, k) for i in (None, 8, 9) for k in (1, 2)} and len(out) == 8
    for rows in ([], odd[:4], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_large_deviations_are_exact_or_refused():
    x = np.array([[1 << 40, -3], [5, 7]], np.int64)
    sums = [(1 << 40) + 5, 4]
    small = W._deviations(x >> 20, 2, [s >> 20 for s in sums])
    assert small.tolist() == [sum((2 * int(a) - (s >> 20)) ** 2 for a, s in zip(row, sums)) for row in x >> 20]
    with pytest.raises(OverflowError):
        W._deviations(x, 2, sums)


def test_solving_inverts_the_factors():
    rng = np.random.RandomState(1)
    factors = [np.triu(rng.rand(5, 5)) + np.eye(5) for _ in range(3)]
    y = rng.rand(9, 5)
    back = W._solved(y, factors)
    for f in reversed(factors):
        back = back @ f
    assert np.allclose(back, y)
