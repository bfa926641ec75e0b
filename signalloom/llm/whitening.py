"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers, ``x = floor(scale * c)``.  The fit list is each distinct ``x`` vector
once; its size ``n`` and sums ``S`` are exact.  Every pass over the fit list centres its rows, solves the
triangular factors found so far, and sums a Gram matrix per task, then across tasks by matrix row.
The driver only holds matrices of the vectors' own width.  The first factor is the Cholesky root
of the Gram matrix with a shift, so that it exists even where the matrix is not of full rank; each
further pass orthogonalises what the last one left, until the columns are orthonormal to rounding.
The product R of the factors has the singular values and right vectors of the centred list, at the
list's own condition instead of its square: components and eigenvalues come from the SVD of R.

Rows whose vector is null or holds null or non-finite entries are left out; so are
vectors of another length than the commonest one (the longer one among equals) and entries that no long can hold once scaled.
Components without variance are not returned: one vector, or none, gives no rows.  Rows
without vec_id and repeated rows are returned as they come.  Equal eigenvalues give some basis of their
space.  Other columns, whatever their names, are not read.  ``deviation`` is exact; where no long can
hold it, the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.vectors import as_doubles, flat
from signalloom.session import written

_PASSES = 8
_EPS = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """What a row needs to be whitened."""

    n: int
    sums: list[int]
    projection: np.ndarray  # a column per component, over sqrt(e)
    explained: np.ndarray
    identity_error: float


def _scaled(scale: int, keep_id: bool):
    """``[vec_id,] embedding`` to ``[vec_id,] x``, the whole numbers as bytes; other rows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, whole = flat(batch.column("embedding"))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * values)
                held = np.abs(x) < 2.0**63
                x = np.where(held, x, 0).astype("<i8")
            lost = np.concatenate([[0], np.cumsum(~held)])
            rows = np.flatnonzero(whole & (lost[at[1:]] == lost[at[:-1]]))
            columns = [pa.array([x[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())]
            names = ["x"]
            if keep_id:
                columns, names = [batch.column("vec_id").take(pa.array(rows)), *columns], ["vec_id", "x"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task ``place, low, high``: sums per entry in two parts, so that no long overflows; place -1 counts the rows."""
    n, low, high = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            n, low, high = n + len(x), low + (x & 0xFFFFFFFF).sum(0), high + (x >> 32).sum(0)
    if n:
        columns = [np.arange(-1, len(low)), np.append(n, low), np.append(0, high)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["place", "low", "high"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x - np.array([float(s // n) for s in sums]) - np.array([s % n / n for s in sums])


def _gram(fit: DataFrame, transform) -> np.ndarray:
    """The Gram matrix of the transformed rows: a matrix per task, added up row by row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                y = transform(_matrix(batch.column("x").slice(s, 4096)))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            g = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * len(total), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), g], names=["row", "g"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("g").combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"row": table.column("row").slice(0, 1), "g": pa.array([rows.sum(0).tolist()], pa.list_(pa.float64()))})

    # as many matrices as the cluster has places, not as the table has files
    spread = fit.coalesce(max(2 * fit.sparkSession.sparkContext.defaultParallelism, 8))
    parts = spread.mapInArrow(part, "row int, g array<double>")
    rows = parts.groupBy("row").applyInArrow(add, "row int, g array<double>").collect()
    return np.array([r["g"] for r in sorted(rows)])


def _solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``y`` times the inverse of every factor, by forward substitution."""
    for r in factors:
        out = np.empty_like(y)
        for j in range(y.shape[1]):
            out[:, j] = (y[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        y = out
    return y


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky root; with a shift where it is asked for or needed."""
    d = len(gram)
    shift = 11 * (n * d + d * (d + 1)) * (_EPS / 2) * np.linalg.norm(gram, 2) if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, d * _EPS * np.linalg.norm(gram, 2))


def cholesky_qr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list."""
    factors: list[np.ndarray] = []
    while len(factors) < _PASSES:
        gram = _gram(fit, lambda x, f=tuple(factors): _solved(_centred(x, n, sums), list(f)))
        if not factors and not np.diag(gram).any():
            return np.zeros_like(gram)
        live = np.diag(gram) > 0.5  # columns that depend on others have nothing left
        off = np.abs(gram - np.eye(len(gram)))[np.ix_(live, live)].max(initial=0.0)
        if factors and live.any() and off < 16 * len(gram) * _EPS and len(factors) > 1:
            break
        if not factors:  # columns of any scale: the root of a matrix with a unit diagonal
            size = np.sqrt(np.diag(gram))
            size[size == 0] = 1.0
            factors.append(np.diag(size))
            gram = gram / np.outer(size, size)
            factors.append(_factor(gram, min(n, 1 << 20), True))
        else:
            factors.append(_factor(gram, n, False))
    r = np.eye(len(factors[0]))
    for f in factors:
        r = f @ r
    return r


def fit_whitening(rows: DataFrame, components: int = 4, scale: int = 256) -> Whitening | None:
    """Learn from ``embedding``; none where no component has variance."""
    distinct = rows.select(as_doubles().alias("embedding")).mapInArrow(_scaled(scale, False), "x binary").distinct()
    fit = written(distinct, "whitening-fit")
    widths = fit.groupBy(F.octet_length("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None or widths["width"] == 0:
        return None
    fit = fit.where(F.octet_length("x") == widths["width"])
    exact = fit.mapInArrow(_sums, "place long, low long, high long").groupBy("place")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = [int(r["low"]) + (int(r["high"]) << 32) for r in sorted(exact.agg(wide("low"), wide("high")).collect())]
    n, sums = sums[0], sums[1:]
    r = cholesky_qr(fit, n, sums)
    _, size, right = np.linalg.svd(r)
    kept = [k for k in range(min(components, len(size))) if size[k] > 1e-13 * size[0]]
    if not kept:
        return None
    projection = right[kept].T / size[kept] * np.sqrt(n)
    covariance = _gram(fit, lambda x: _centred(x, n, sums) @ projection) / n
    error = float(np.abs(covariance - np.eye(len(kept))).max())
    return Whitening(n, sums, projection, size[kept] ** 2 / (size**2).sum(), error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of ``(n x - S)**2`` over entries, exact: longs where they surely hold them, Python's integers otherwise."""
    most = int(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums)) + n
    if most**2 * x.shape[1] < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
    wide = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    if max(wide, default=0) >= 2**63:
        raise OverflowError("a deviation is beyond a long")
    return wide.astype(np.int64)


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, embedding`` to one row per vector and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(rows, components, scale)
    if model is None:
        return rows.sparkSession.createDataFrame([], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = model.projection.shape
        for whole in batches:
            for s in range(0, whole.num_rows, 4096):
                batch = whole.slice(s, 4096)
                x = _matrix(batch.column("x"))
                m = len(x)
                each = np.repeat(np.arange(m), k)
                flat_ = (_centred(x, model.n, model.sums) @ model.projection).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                        pa.array(_deviations(x, model.n, model.sums)[each], pa.int64()), pa.array(flat_), pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    scaled = rows.select("vec_id", as_doubles().alias("embedding")).mapInArrow(_scaled(scale, True), f"vec_id {kind}, x binary")
    return scaled.where(F.octet_length("x") == 8 * len(model.sums)).mapInArrow(run, columns)
