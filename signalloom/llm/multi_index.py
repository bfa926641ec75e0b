"""Near duplicates among embeddings by an inverted multi-index.

Vectors are scaled to length one and cut into halves.  A codebook per half (k-means on
a bounded sample, ``fit_rows``) sends each half to its nearest centroid, so that a pair of
centroids is a cell of a product grid; every row is indexed, and a cell holds rows of one label.

A vector visits cells in the order of the multi-sequence traversal: cells ascend by the sum
of both halves' squared excess, the distance from the half to the border of the centroid's
region.  No vector inside a cell is nearer than its excess, so a cell beyond the squared
distance that the cosine allows, 2 - 2 cosine, cannot hold a partner: with ``recall=1``
the traversal ends there and loses nothing.  Below 1 it ends earlier, at a reach measured
on a sample of rows: these ``queries`` meet all rows, in blocks, and the reach is twice what
the wanted share of their links needs, at least that of two standard deviations of a
difference in random directions.  Candidates are verified by their cosine in double precision.

Equal vectors of one label are one class with a weight.  Of two cells the lower one's
vectors visit the higher one's.  A crowded cell is dealt out: its hosts in blocks, its
visitors in blocks, and each pair of blocks is one tile.  A tile returns, per
class, the weight of its partners, and a spanning forest of its links; no pairs leave it.

Vectors that are null, zero or hold null or non-finite entries, and rows without label,
link with nothing.  Vectors of different length are never compared; those of another length than
the commonest have one cell a label.  Each row counts as a vector of its own, repeated
rows and ids too.  Rows without vec_id keep their row, never name a component and are not kept.
Other columns, whatever their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.components import components
from signalloom.llm.vectors import as_doubles, flat
from signalloom.session import discard, written

_BLOCK = 2048  # rows of a side of a tile
_SMALL_TABLE = 100_000  # rows of a table that every task may hold
_STEPS = 400  # how finely a reach is measured


@dataclass
class Grid:
    """Codebooks of both halves."""

    dim: int
    first: np.ndarray
    second: np.ndarray

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of unit vectors, and the squared excess of either half over each region."""
        half = self.dim // 2
        at, out = [], []
        for part, book in ((x[:, :half], self.first), (x[:, half:], self.second)):
            d = np.maximum((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1), 0)
            near = d.argmin(1)
            apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(-1))
            over = np.zeros_like(d)
            for k in range(len(book)):  # the farthest of all borders of a region
                between = np.where(apart[k] > 0, apart[k], np.inf)
                np.maximum(over, (d - d[:, [k]]) / (2 * between), out=over)
            at.append(near), out.append(over**2)
        return at[0] * len(self.second) + at[1], out[0], out[1]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _described(single: bool):
    """``vec_id, label, embedding`` to rows with the vector as bytes (null: links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at, whole = flat(batch.column("embedding"))
            raw = []
            for i in range(batch.num_rows):
                x = values[at[i] : at[i + 1]]
                raw.append(x.astype("<f4" if single else "<f8").tobytes() if whole[i] and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    return run


def _vectors(column: pa.Array, single: bool) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<f4" if single else "<f8") for x in column]


def _k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = np.unique(x, axis=0)
    centres = centres[np.random.RandomState(11).permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_grid(classes: DataFrame, n: int, n_labels: int, dim: int, single: bool, fit_rows: int) -> Grid:
    """Codebooks from about ``fit_rows`` classes; their size follows the rows a label has, up to 64 a half."""
    few = classes.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("key"), F.lit(n)) < fit_rows).select("raw")
    x = _unit(np.array(_vectors(few.toArrow().column("raw"), single), np.float64).reshape(-1, dim))
    x = x[np.lexsort(x.T[::-1])] if len(x) else np.zeros((1, dim))
    k = int(np.clip(round((n / max(n_labels, 1) / 48) ** 0.5), 2, 64))
    half = dim // 2
    return Grid(dim, _k_means(x[:, :half], k), _k_means(x[:, half:], k))


def measured_reach(classes: DataFrame, grid: Grid, n: int, single: bool, cosine: float, recall: float, queries: int) -> float:
    """The sum of excesses at which the traversal ends: twice what ``recall`` of the links of about
    ``queries`` sampled classes to all classes need, each sampled class counting alike."""
    most = 2 - 2 * cosine
    if recall >= 1:
        return most
    sampled = classes.where(F.col("dim") == grid.dim).where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n)) < queries)
    asked = sampled.select("node", F.col("label").cast("string").alias("label"), "raw").toArrow()
    if not asked.num_rows:
        return most
    nodes, names = asked.column("node").to_numpy(), {}
    labels = np.array([names.setdefault(x, len(names)) for x in asked.column("label").to_pylist()])
    q = _unit(np.array(_vectors(asked.column("raw"), single), np.float64))
    _, a, b = grid.excess(q)
    width = len(grid.second)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(np.array(_vectors(batch.column("raw"), single), np.float64))
            cell, _, _ = grid.excess(x)
            same = labels[:, None] == np.array([names.get(y, -1) for y in batch.column("label").to_pylist()])[None]
            i, j = np.nonzero((q @ x.T >= cosine) & same & (nodes[:, None] != batch.column("node").to_numpy()[None]))
            step = np.ceil((a[i, cell[j] // width] + b[i, cell[j] % width]) / most * _STEPS).clip(0, _STEPS).astype(np.int64)
            at, count = np.unique(i * (_STEPS + 1) + step, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at // (_STEPS + 1)), pa.array(at % (_STEPS + 1)), pa.array(count)], names=["q", "step", "n"])

    rows = classes.where(F.col("dim") == grid.dim).select("node", F.col("label").cast("string").alias("label"), "raw")
    found = rows.mapInArrow(meet, "q long, step long, n long").groupBy("q", "step").agg(F.sum("n").alias("n")).toArrow()  # at most queries x steps rows
    need = np.zeros((len(nodes), _STEPS + 1))
    need[found.column("q").to_numpy(), found.column("step").to_numpy()] = found.column("n").to_numpy()
    need = need[need.sum(1) > 0]
    wanted = 0.0
    if len(need):
        share = np.cumsum(need / need.sum(1, keepdims=True), axis=1).mean(0)
        wanted = float(np.argmax(share >= recall - 1e-12)) / _STEPS * most
    return min(most, max(2 * wanted, 4 * most / grid.dim))


def _placed(grid: Grid, single: bool, reach: float):
    """Classes with their cell and the higher cells they visit."""
    cells = len(grid.first) * len(grid.second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                raw = _vectors(batch.column("raw"), single)
                rows = np.flatnonzero([len(x) == grid.dim for x in raw])
                cell, visits = np.zeros(len(raw), np.int64), [[]] * len(raw)
                if len(rows):
                    own, a, b = grid.excess(_unit(np.array([raw[i] for i in rows], np.float64)))
                    cell[rows] = own
                    near = (a[:, :, None] + b[:, None, :]).reshape(-1, cells) <= reach
                    near &= np.arange(cells) > own[:, None]
                    for i, row in zip(rows, near):
                        visits[i] = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("node", "label", "dim", "weight", "raw")), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))],
                    names=["node", "label", "dim", "weight", "raw", "cell", "visits"],
                )

    return run


def _tiles(placed: DataFrame) -> DataFrame:
    """Hosts and visitors of every cell, dealt to tiles ``(label, dim, cell, p, q)`` of a block of each; hosts visit their own cell too."""
    cell = ["label", "dim", "cell"]
    visits = F.explode(F.array_append("visits", F.col("cell")))
    visiting = placed.select("node", "label", "dim", "weight", "raw", F.col("cell").alias("home"), visits.alias("cell"))
    visitors = placed.select("label", "dim", visits.alias("cell")).groupBy(*cell).agg(F.count("*").alias("nv"))
    hosts = placed.groupBy(*cell).agg(F.count("*").alias("nh"))
    blocks = hosts.join(visitors, cell).select(*cell, *[F.ceil(F.col(c) / _BLOCK).cast("int").alias(c) for c in ("nh", "nv")])
    crowded = written(blocks.where("nh > 1 OR nv > 1"), "multi-crowded")
    if crowded.count() <= _SMALL_TABLE:
        crowded = F.broadcast(crowded)

    def dealt(rows: DataFrame, own: str, other: str, mine: str, theirs: str, kind) -> DataFrame:
        sized = rows.join(crowded, cell, "left").withColumns({"nh": F.coalesce("nh", F.lit(1)), "nv": F.coalesce("nv", F.lit(1))})
        return sized.select(
            *cell, F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs),
            kind.alias("kind"), "node", "weight", "raw",
        )

    left = dealt(placed.drop("visits"), "nh", "nv", "p", "q", F.lit(0))
    return left.unionByName(dealt(visiting, "nv", "nh", "q", "p", F.when(F.col("home") == F.col("cell"), 1).otherwise(2)))


def _linked(cosine: float, single: bool):
    """A tile's rows to ``node, links``, the weight of a class's partners there, and ``u, v``, a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        node, weight, kind = (table.column(c).to_numpy() for c in ("node", "weight", "kind"))
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), "<f4" if single else "<f8").reshape(len(node), -1).astype(np.float64)
        x = _unit(x)
        names, at = np.unique(node, return_inverse=True)
        left, right = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
        links, parent, tree = np.zeros(len(names), np.int64), list(range(len(names))), []
        for s in range(0, len(right), 512):
            r = right[s : s + 512]
            near = x[r] @ x[left].T >= cosine
            near &= (kind[r] == 2)[:, None] | (node[r][:, None] > node[left][None])  # hosts among themselves meet once
            links[at[left]] += weight[r] @ near
            links[at[r]] += near @ weight[left]
            for i in np.flatnonzero(near.any(1)):
                mine = at[r[i]]
                for j in at[left[near[i]]].tolist():
                    a, b = int(mine), j
                    while parent[a] != a:
                        parent[a] = a = parent[parent[a]]
                    while parent[b] != b:
                        parent[b] = b = parent[parent[b]]
                    if a != b:
                        parent[a] = b
                        tree.append((names[mine], names[j]))
        some = links > 0
        u, v = np.array(tree, np.int64).reshape(-1, 2).T
        none, blank = pa.nulls(int(some.sum()), pa.int64()), pa.nulls(len(u), pa.int64())
        return pa.table({
            "node": pa.concat_arrays([pa.array(names[some], pa.int64()), blank]), "links": pa.concat_arrays([pa.array(links[some], pa.int64()), blank]),
            "u": pa.concat_arrays([none, pa.array(u, pa.int64())]), "v": pa.concat_arrays([none, pa.array(v, pa.int64())]),
        })

    return run


def link(
    rows: DataFrame, cosine: float = 0.98, recall: float = 0.9999, fit_rows: int = 20_000, queries: int = 256,
) -> DataFrame:
    """``vec_id, embedding, label`` to ``vec_id, n_links, component_id, kept``, one row per vector."""
    kind = rows.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    told = rows.select("vec_id", "label", as_doubles().alias("embedding")).mapInArrow(_described(single), f"vec_id {ids}, label {labels}, raw binary")
    key = F.when(F.col("label").isNotNull(), F.unhex(F.md5(F.concat("raw", F.col("label").cast("string").cast("binary")))))
    described = written(told.withColumn("key", key), "multi-described")
    width = 4 if single else 8
    grouped = described.where("key IS NOT NULL").groupBy("key", "label", "raw").agg(F.count("*").alias("weight"), F.min("vec_id").alias("vec_id"))
    classes = written(grouped.select("*", F.monotonically_increasing_id().alias("node"), (F.octet_length("raw") / width).cast("int").alias("dim")), "multi-classes")
    common = classes.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return described.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    grid = fit_grid(classes, common["n"], common["labels"], common["dim"], single, fit_rows)
    reach = measured_reach(classes, grid, common["n"], single, cosine, recall, queries)
    columns = f"node long, label {labels}, dim int, weight long, raw binary, cell long, visits array<long>"
    placed = written(classes.select("node", "label", "dim", "weight", "raw").mapInArrow(_placed(grid, single, reach), columns), "multi-placed")
    tiles = _tiles(placed).groupBy("label", "dim", "cell", "p", "q")
    found = written(tiles.applyInArrow(_linked(cosine, single), "node long, links long, u long, v long"), "multi-links")
    counts = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = written(components(found.where("node IS NULL").select("u", "v")), "multi-components")

    labelled = classes.select("node", "key", "weight", "vec_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = written(labelled.join(counts, "node", "left"), "multi-labels")
    names = labelled.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    partners = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("partners")
    answer = labelled.join(names, "component").select("key", partners, "component_id")
    discard(placed)
    told = described.select("vec_id", "key").join(answer, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return told.select(
        "vec_id", F.coalesce("partners", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
