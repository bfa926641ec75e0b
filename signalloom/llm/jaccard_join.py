"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct k-word shingles (64-bit hashes; equal shingles have
equal hashes, different ones meet with probability 2**-64).  Equal sets are one class.

Classes that can be linked meet in tiles.  Up to about a hundred shingles a class enters
the tile of each hash of its prefix, which every partner's prefix has to meet.  Larger
classes enter the tiles of the least hash in each of 24 hash ranges: a linked partner
has a given one in common with probability of at least the threshold, so that a link at 0.85
stays unseen with probability 0.15**24, i.e. less than a hash collision.

Inside a tile classes are sorted by size and compared in blocks with the blocks whose
sizes can reach the threshold.  A signature holds the parity of the shingles per hashed bit,
so the bits in which two signatures differ are at most the shingles in which the sets
differ, which bounds the overlap from above.  Pairs within the bound go to the exact
intersection of sorted arrays.  Tiles above a size are cut into pairs of blocks of classes.

No step emits all pairs of a group.  First every class proposes its nearest earlier neighbours.  Then, in tiles whose
classes are not yet of one component, a class that still has a pair within the bound asks for its
set: a row per class, where ranges make several tiles of a pair only in the first of them.  The sets come to the tile, which decides its pairs itself
and returns a spanning forest of the links, at most a link less than it has classes.

Rows are told apart by doc_id and text, so a repeated doc_id with another text is another row.  Null and empty texts
have no shingles and are linked with nothing.  Fewer words than k are one shingle.  Repeated rows share a class.  Rows without
doc_id are compared as any others, but never name a component.  Other columns, whatever their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from signalloom.llm.common import chunks, hinted, hints_of, mix, shingle_hashes, text_bytes, word_hashes
from signalloom.llm.components import components
from signalloom.session import discard, written

_RANGES, _SMALL, _BLOCK, _NEAREST, _STEP = 24, 100, 4096, 2, 256
_EDGES = (np.arange(_RANGES, dtype=np.float64) / _RANGES * 2.0**64).astype(np.uint64)
_SETS = "doc_id {id}, th long, n long, node long, keys array<long>, bits binary, fine binary"
_BLOCK_SHINGLES = 1 << 21  # of a side of a tile whose sets are at hand
_COARSE_BITS, _FINE_BITS = 8, 32  # signature bits per shingle in which linked sets can differ


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _needed(n: int, percent: int) -> int:
    """The least overlap with any linked partner."""
    return -(-percent * n // 100)


def signature_bits(n: int, percent: int, times: int) -> int:
    """A power of two, ``times`` the shingles in which linked sets of this size can differ."""
    differ = max(1, 2 * n * (100 - percent) // (100 + percent))
    return max(256, 1 << (times * differ - 1).bit_length())


def _signature(u: np.ndarray, percent: int, times: int) -> bytes:
    bits = signature_bits(len(u), percent, times)
    odd = np.bincount((mix(u) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _tile_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """``u`` sorted.  Classes near the border enter both kinds of tiles, so that every pair shares a kind."""
    n, keys = len(u), []
    if n * percent <= _SMALL * 100:
        keys.append(mix(u[: n - _needed(n, percent) + 1]))
    if n > _SMALL:
        at = np.append(np.searchsorted(u, _EDGES), n)
        keys.append(mix(u[at[:-1][at[:-1] < at[1:]]] + np.uint64(1)))
    return np.concatenate(keys)


def _node(u: np.ndarray) -> int | None:
    """The class of a set."""
    if not len(u):
        return None
    with np.errstate(over="ignore"):
        return int(_signed(mix(np.array([mix(u).sum() + np.uint64(len(u))], np.uint64)))[0])


def _document_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    raw, offsets = text_bytes(batch.column("text"))
    hashed, owner = shingle_hashes(*word_hashes(raw, offsets), k)
    order = np.argsort(owner, kind="stable")
    hashed, owner = hashed[order], owner[order]
    at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        yield np.unique(hashed[at[i] : at[i + 1]])


def _describe(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole)):
            ns, nodes, keys, bits, fine = [], [], [], [], []
            for u in _document_sets(batch, k):
                ns.append(len(u))
                nodes.append(_node(u))
                keys.append(_signed(_tile_keys(u, percent)) if len(u) else [])
                bits.append(_signature(u, percent, _COARSE_BITS) if len(u) else b"")
                fine.append(_signature(u, percent, _FINE_BITS) if len(u) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "th", "n", "node", "keys", "bits", "fine"],
            )

    return run


def _sets(k: int):
    """Rows with ``text`` to their other columns and ``shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole)):
            found = pa.array([u.tobytes() for u in _document_sets(batch, k)], pa.binary())
            yield batch.drop_columns(["text"]).append_column("shingles", found)

    return run


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Signatures cut to ``words`` 64-bit words: in a shorter signature of the same set the parities of the halves add up."""
    out = np.empty((len(bits), words), np.uint64)
    for i, x in enumerate(bits):
        row = np.frombuffer(x, np.uint64)
        while len(row) > words:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _close(n: np.ndarray, bits: list[bytes], percent: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs (later, earlier, differing bits) within the bound; ``n`` ascends."""
    for a in range(0, len(n), step):
        e = min(a + step, len(n))
        first = int(np.searchsorted(n, _needed(int(n[a]), percent)))
        for b in range(first, e, step):
            f = min(b + step, e)
            words = min(len(bits[a]), len(bits[b])) // 8
            left, right = _folded(bits[a:e], words), _folded(bits[b:f], words)
            differ = np.zeros((e - a, f - b), np.int64)
            for w in range(words):
                differ += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
            total = n[a:e, None] + n[None, b:f]
            # overlap o >= t (total - o) and differing shingles = total - 2 o
            reach = (100 + percent) * differ <= (100 - percent) * total
            reach &= np.arange(a, e)[:, None] > np.arange(b, f)[None, :]
            i, j = np.nonzero(reach)
            if len(i):
                yield i + a, j + b, differ[i, j]


def _by_tile(decide, names: list[str]):
    """Rows sorted by ``tile`` to what ``decide`` makes of every tile: equally long lists, one per name, or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            part = table.column("tile").to_numpy()
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            for s, e in zip(edges, np.append(edges[1:], len(part))):
                if e - s > 1 and (out := decide(table.slice(s, e - s))) is not None:
                    yield pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles = batch.column("tile").to_numpy()
            last = int(np.flatnonzero(tiles != tiles[-1])[-1]) + 1 if (tiles != tiles[-1]).any() else 0
            if held and (last or held[-1].column("tile")[-1].as_py() != tiles[-1]):
                yield from finish(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            elif not held and last:
                yield from finish(pa.Table.from_batches([batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from finish(pa.Table.from_batches(held))

    return run


def _sorted_tile(table: pa.Table, *columns: str) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    order = np.lexsort((table.column("node").to_numpy(), table.column("n").to_numpy()))
    bits = table.column("bits").to_pylist()
    return [table.column(c).to_numpy()[order] for c in columns], [bits[i] for i in order], order


def _propose(percent: int, nearest: int):
    """A tile to pairs: every class with its nearest earlier neighbours within the bound."""

    def first(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = map(np.concatenate, zip(*held))
        best = np.lexsort((j, d, i))
        i, j, d = i[best], j[best], d[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < nearest
        return i[kept], j[kept], d[kept]

    def decide(table: pa.Table):
        (n, node), bits, _ = _sorted_tile(table, "n", "node")
        found, held, block = [], [], -1
        for i, j, d in _close(n, bits, percent, _STEP):  # pairs of one block of later classes after another
            if i[0] // _STEP != block and held:
                found.append(first(held))
                held = []
            block = i[0] // _STEP
            held.append((i, j, d))
        if not held:
            return None
        i, j, d = map(np.concatenate, zip(*found, first(held)))
        return [pa.array(x, pa.int64()) for x in (node[i], node[j], d)]

    return _by_tile(decide, ["u", "v", "d"])


def _apart(i, j, comp, side) -> np.ndarray:
    """Pairs of different components; in a tile of two blocks only those between them."""
    return (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))


def _asking(percent: int):
    """A tile to the classes that have a pair within the bound, of different components, which no earlier range has in common."""

    def decide(table: pa.Table):
        (n, node, comp, side, key), bits, order = _sorted_tile(table, "n", "node", "comp", "side", "key")
        ranges, long = np.zeros((len(n), _RANGES), np.int64), np.zeros(len(n), bool)
        for row, at in enumerate(order):  # with as many keys as ranges, each is a range's least hash
            keys = table.column("keys")[int(at)].as_py()
            if len(keys) == _RANGES:
                ranges[row], long[row] = keys, True
        wanted = np.zeros(len(n), bool)
        for i, j, _ in _close(n, bits, percent, _STEP):
            far = _apart(i, j, comp, side)
            i, j = i[far], j[far]
            for s in range(0, len(i), 65_536):
                a, b = i[s : s + 65_536], j[s : s + 65_536]
                common = ranges[a] == ranges[b]
                first = ranges[a, common.argmax(1)]
                here = ~(long[a] & long[b] & common.any(1)) | (first == key[a])
                wanted[a[here]] = True
                wanted[b[here]] = True
        if not wanted.any():
            return None
        kept = pa.array(order[wanted])
        return [table.column(c).combine_chunks().take(kept) for c in ("tile", "node", "n", "comp", "side", "bits")]

    return _by_tile(decide, ["tile", "node", "n", "comp", "side", "bits"])


def _decided(percent: int):
    """A tile with its sets to a spanning forest of its links."""

    def decide(table: pa.Table):
        (n, node, comp, side), bits, order = _sorted_tile(table, "n", "node", "comp", "side")
        sets = [np.frombuffer(table.column("shingles")[int(r)].as_buffer(), np.uint64) for r in order]
        names, root = np.unique(comp, return_inverse=True)
        parent, us, vs = list(range(len(names))), [], []
        for i, j, _ in _close(n, bits, percent, _STEP):
            far = _apart(i, j, comp, side)
            for a, b in zip(i[far].tolist(), j[far].tolist()):
                x, y = int(root[a]), int(root[b])
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x == y:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[x] = y
                    us.append(int(node[a])), vs.append(int(node[b]))
        return [pa.array(us, pa.int64()), pa.array(vs, pa.int64())] if us else None

    return _by_tile(decide, ["u", "v"])


def _nearest(members: DataFrame, percent: int, nearest: int) -> DataFrame:
    """``key, node, n, bits`` (tiles with company only) and their ``size`` to distinct pairs of near classes."""
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / _BLOCK).cast("int"))  # neighbours are looked for in a class's own block
    rows = members.select(F.xxhash64("key", own).alias("tile"), "node", "n", "bits").repartition("tile").sortWithinPartitions("tile")
    found = rows.mapInArrow(_propose(percent, nearest), "u long, v long, d long")
    # of all its tiles' proposals a class keeps the nearest; at most ``nearest`` came out of each of its tiles
    best = found.groupBy("u").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "v"))), 1, nearest).alias("best"))
    return best.select("u", F.explode("best.v").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _rest(members: DataFrame, sets, percent: int) -> DataFrame:
    """``key, node, n, bits, keys, comp``, the ``size`` of the tile and its ``shingles`` in all, to the links between components.

    ``sets`` adds ``shingles`` to rows of ``node``.
    """
    blocks = F.greatest(F.ceil(F.col("size") / _BLOCK), F.ceil(F.col("all") / _BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # every pair of blocks meets once; side tells the two blocks of a tile apart, 2: a block with itself
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    placed = members.select("*", own.alias("own"), other).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "key", "node", "n", "comp",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long").alias("side"), "bits", "keys",
    )
    columns = "tile long, node long, n long, comp long, side long, bits binary"
    asking = written(placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_asking(percent), columns), "jaccard-asking")
    # a class's set is made once and goes from there to all tiles that it asks in
    tiles = F.collect_list(F.struct("tile", "comp", "side")).alias("tiles")
    wanted = asking.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), tiles)
    filled = sets(wanted).select("node", "n", "bits", "shingles", F.inline("tiles"))
    return filled.repartition("tile").sortWithinPartitions("tile").mapInArrow(_decided(percent), "u long, v long")


def _within(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs that the longer signatures still allow."""
    side = lambda c: fine.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("nu", "nv", "fu", "fv"))):
                words = min(len(x), len(y)) // 8
                differ = int(np.bitwise_count(_folded([x], words) ^ _folded([y], words)).sum())
                keep.append((100 + percent) * differ <= (100 - percent) * (a + b))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "fu", "fv").mapInArrow(run, "u long, v long")


def _fetch(docs: DataFrame, classes: DataFrame, k: int):
    """A function that adds ``shingles`` to rows of ``node`` and others, and the tables it has written: a class's set is made again from the text of the row that stands for it."""
    made: list[DataFrame] = []

    def sets(wanted: DataFrame) -> DataFrame:
        asked = written(wanted.join(classes, "node"), "jaccard-asked")
        made.append(asked)
        hints = hints_of(asked, "th", "idh")
        # repeated rows leave one, and are dealt as the join needs them
        texts = hinted(docs.select("th", "idh", "text"), hints).dropDuplicates(["th", "idh"]).join(asked, ["th", "idh"]).drop("th", "idh")
        fields = [f for f in texts.schema.fields if f.name != "text"]
        return texts.mapInArrow(_sets(k), StructType([*fields, StructField("shingles", BinaryType())]))

    return sets, made


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets, in ``held``, reach the threshold, by intersecting sorted arrays."""
    left = held.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = held.select(F.col("node").alias("v"), F.col("shingles").alias("b"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(linked, "u long, v long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


def members(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, text`` to ``doc_id, th, n_shingles, component, component_id``, one row per document.

    ``th`` is the hash of the text, ``component`` a number of the group (null without shingles) that does not depend on ids.
    Wide columns (texts, sets, signatures, keys) are shuffled for those classes only that a step asks for.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    idh = F.xxhash64("doc_id").alias("idh")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    described = written(docs.mapInArrow(_describe(k, percent), _SETS.format(id=kind)), "jaccard-described")
    named = described.where("node IS NOT NULL")
    standing = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("row")
    classes = written(named.groupBy("node").agg(standing).select("node", "row.doc_id", "row.th"), "jaccard-classes")
    stands = classes.select("node", "th", idh)
    row = ["node", "th", "idh"]
    own = written(named.select("node", "th", idh, "n", "keys", "bits").dropDuplicates(row).join(stands, row, "left_semi").select("node", "n", "keys", "bits"), "jaccard-own")
    postings = own.select("node", "n", F.explode("keys").alias("key"))
    met = written(postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-met")
    crowded = hints_of(met, "key")
    shared = written(hinted(postings, crowded).join(met, "key"), "jaccard-shared")
    discard(met)
    sets, made = _fetch(docs.select("th", idh, "text"), stands, k)

    first = written(_nearest(shared.join(own.select("node", "bits"), "node"), percent, _NEAREST), "jaccard-nearest")
    paired = hints_of(_ends(first), "node")
    fine = hinted(described.select("node", "n", "fine"), paired).dropDuplicates(["node"])
    allowed = written(_within(first, fine, percent), "jaccard-allowed")
    rows = written(described.select("doc_id", "th", "n", "node"), "jaccard-rows")
    discard(described, first)
    held = written(sets(_ends(allowed).distinct()), "jaccard-sets")
    links = written(_verified(allowed, held, percent), "jaccard-links")
    discard(held, allowed, *made)
    made.clear()
    found = written(components(links), "jaccard-components")

    comp = F.coalesce("component", "node").alias("comp")
    placed = shared.join(found, "node", "left").select("key", "node", "n", "size", comp)
    apart = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("all")).where("low < high").select("key", "all")
    mixed = written(placed.join(apart, "key"), "jaccard-mixed")  # only classes in tiles with several components need keys and bits again
    asking = hints_of(mixed, "node")
    more = written(_rest(mixed.join(hinted(own.select("node", "keys", "bits"), asking), "node"), sets, percent), "jaccard-links")
    stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))  # shorter chains than the links
    final = written(components(stars.union(more)), "jaccard-components")
    discard(own, shared, mixed, *made)

    label = classes.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    label = written(label, "jaccard-labels")
    names = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = label.select("node", "component").join(names, "component")
    return rows.select("doc_id", "th", "node", F.col("n").alias("n_shingles")).join(answer, "node", "left").select(
        "doc_id", "th", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def link(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_shingles, component_id``, one row per document."""
    return members(docs, k, percent).select("doc_id", "n_shingles", "component_id")
