"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of words, and passages are runs of blocks.  Terms are hashed to a
fixed number of places and weighted by TF-IDF, with counts over all passages.  A randomised
SVD finds the latent space: one distributed pass multiplies the transposed matrix with
random signs (the signs are added as bits, eight directions to a number, and in the pass that counts the terms),
the range of that product is made orthogonal, a second pass sums the small
Gram matrix of the projected rows.  It is fitted on all documents
and on all benchmark items; the search then reads every passage of every document.  A
passage's vector is the sum of its blocks' vectors, scaled by the singular values.

A passage meets items by their nearest piece: an item longer than a passage is compared whole and
in runs of passage size.  Cosine candidates are only candidates: those go whose surroundings, all that
the judge reads, share too few of the item's rarer words (found through postings from words to items), and the longest common subsequence of words with
the passage's surroundings decides.  From ``exact`` of an
item on it is a leak; from ``loose`` on (a paraphrase) it is one if the answer, the item's
last part, is there too, in order.  Items are the query set; they are bounded blocks of
rows, each searched against all documents.

Null and empty texts hold nothing and leak nothing; so do null items and items under five
words.  Repeated rows are judged alike.  Documents without doc_id are judged as well.  An
empty table of either kind gives no leaks.  Texts are read whole, in chunks of rows.  A column of the documents called
``leaks`` is replaced in what :func:`mark` returns and kept by :func:`without_leaks`; other names do not matter.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import chunks, mix, text_bytes, word_hashes
from signalloom.session import written

_TERMS, _BLOCK, _LATENT, _OVER, _ITEMS = 1 << 15, 12, 64, 16, 4096
_DIRECTIONS = _LATENT + _OVER
_RUN = 255  # ones that a byte can count
_SPREAD_BYTES = 2 << 20  # of text at a time, as every word takes a row of signs
_SLICES, _SLICE = 64, "slice long, counts binary, signs binary, blocks long"
_COLUMNS = 256  # items whose words are counted at a time
_SPARED = 0.75  # of the part of an item that has to be shared, so much may come from words that are not looked up
_NARROW, _WIDE, _SHORT = 2, 4, 30  # blocks in a passage for items of up to _SHORT words, and for longer ones
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[ord(c) for c in string.punctuation]] = 32

LEAKS = "array<struct<item_id:{id},cosine:double,common:double,answer:double,at:long>>"


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(pa.compute.utf8_lower(column))  # capitals beyond A-Z too
    return word_hashes(_PLAIN[raw], offsets)


def _blocks(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words where blocks begin, and each text's first block (n + 1)."""
    counts = np.diff(begin)
    blocks = -(-counts // _BLOCK)
    first = np.append(0, np.cumsum(blocks))
    owner = np.repeat(np.arange(len(counts)), blocks)
    return begin[owner] + (np.arange(len(owner)) - first[owner]) * _BLOCK, first


def _term(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - 15)).astype(np.int64)


def _block_terms(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms by block, with _TERMS where a text's last block is short; blocks' first words; each text's first block."""
    starts, first = _blocks(begin)
    ends = np.repeat(begin[1:], np.diff(first))
    at = starts[:, None] + np.arange(_BLOCK)
    inside = at < ends[:, None]
    return np.where(inside, _term(words)[np.where(inside, at, 0)], _TERMS) if len(starts) else np.zeros((0, _BLOCK), np.int64), starts, first


def _signs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A random row of signs for every block, from its words; a one stands for plus."""
    key = np.add.reduceat(mix(words + np.uint64(7)), starts)
    bits = [np.unpackbits(mix(key + np.uint64(i)).view(np.uint8).reshape(-1, 8), axis=1) for i in range(-(-_DIRECTIONS // 64))]
    return np.ascontiguousarray(np.concatenate(bits, axis=1)[:, :_DIRECTIONS])


def _spread(words: np.ndarray, begin: np.ndarray, out: np.ndarray) -> None:
    """Add the signs of all words' blocks to ``out``, terms x directions: the transposed matrix of counts times random signs.

    Bytes of ones are added eight at a time, in runs of a term that are too short to overflow.
    """
    starts, _ = _blocks(begin)
    if not len(starts):
        return
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    term = _term(words).astype(np.uint16)
    order = np.argsort(term, kind="stable")
    term = term[order]
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
    runs = np.flatnonzero(place % _RUN == 0)
    ones = np.add.reduceat(_signs(words, starts).view(np.uint64)[block[order]], runs, axis=0).view(np.uint8)
    sums = 2 * ones.astype(np.int32) - np.diff(np.append(runs, len(term)))[:, None].astype(np.int32)
    out[term[first]] += np.add.reduceat(sums, np.searchsorted(runs, first), axis=0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of terms: in how many blocks they are, and their sums of signs; the first slice tells the blocks."""
    counts, signs, rows = np.zeros(_TERMS + 1, np.int64), np.zeros((_TERMS, _DIRECTIONS), np.int32), 0
    for part in (p for b in batches for p in chunks(b, limit=_SPREAD_BYTES)):
        words, begin = _words(part.column("text"))
        terms, _, _ = _block_terms(words, begin)
        terms = np.sort(terms, axis=1)
        fresh = np.ones(terms.shape, bool)
        fresh[:, 1:] = terms[:, 1:] != terms[:, :-1]
        counts += np.bincount(terms[fresh], minlength=_TERMS + 1)
        rows += len(terms)
        _spread(words, begin, signs)
    if rows:
        yield _slices(counts[:_TERMS], signs, rows)


def _slices(counts: np.ndarray, signs: np.ndarray, rows: int) -> pa.RecordBatch:
    data = [[x.tobytes() for x in np.split(v, _SLICES)] for v in (counts, signs)]
    blocks = pa.array([rows] + [0] * (_SLICES - 1), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int64()), *[pa.array(d, pa.binary()) for d in data], blocks], names=["slice", "counts", "signs", "blocks"])


def _add_slices(key: tuple, table: pa.Table) -> pa.Table:
    counts = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
    signs = sum(np.frombuffer(x.as_buffer(), np.int32).astype(np.float64) for x in table.column("signs"))
    columns = [key[0].as_py()], [counts.tobytes()], [signs.astype(np.float32).tobytes()], [pa.compute.sum(table.column("blocks")).as_py()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("slice", "counts", "signs", "blocks"), columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))})


def _project(words: np.ndarray, begin: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks' vectors (``basis`` holds the weights), and each text's first block."""
    terms, _, first = _block_terms(words, begin)
    rows = np.vstack([basis, np.zeros((1, basis.shape[1]), basis.dtype)])
    out = np.zeros((len(terms), basis.shape[1]), np.float32)
    for j in range(_BLOCK):
        out += rows[terms[:, j]]
    return out, first


def _passages(blocks: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of runs of ``width`` blocks, one starting at each block (shorter at a text's end)."""
    total = blocks.copy()
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for j in range(1, width):
        if len(blocks) > j:
            same = owner[:-j] == owner[j:]
            total[:-j][same] += blocks[j:][same]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12), owner


class _Item:
    """A benchmark item ready for comparison: bit masks of its words' places."""

    def __init__(self, item_id, words: np.ndarray):
        self.id, self.words, self.size = item_id, words.tolist(), len(words)
        self.answer_from = self.size - max(3, self.size // 4)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.times = {w: m.bit_count() for w, m in self.masks.items()}

    def common(self, words: list[int], since: int = 0) -> int:
        """Length of the longest common subsequence with the item's words from ``since`` on."""
        size = self.size - since
        whole = (1 << size) - 1
        row = whole
        for w in words:
            m = self.masks.get(w, 0) >> since
            if m:
                u = row & m
                row = (row + u | row - u) & whole
        return size - row.bit_count()


def _pieces(rows: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors of an item: the whole, and, where it is longer than a passage, runs of ``width`` blocks half a passage apart."""
    begins = [*range(0, len(rows) - width, max(1, width // 2)), len(rows) - width] if len(rows) > width else []
    out = np.stack([rows.sum(axis=0), *[rows[b : b + width].sum(axis=0) for b in begins]])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Searcher:
    """The latent space and the items of one block of the query set."""

    def __init__(self, basis: np.ndarray, idf: np.ndarray, items: list[_Item], rows: list[np.ndarray], cosine: float, exact: float, loose: float):
        """``rows``: every item's block vectors; ``idf`` of terms."""
        self.basis, self.items, self.cosine, self.exact, self.loose = basis, items, cosine, exact, loose
        self.needs = np.zeros(len(items))
        words, owners = [], []
        for i, x in enumerate(items):
            # the item's rarer words; the others could all be in the common part
            own, times = np.array(list(x.times), np.uint64), np.array(list(x.times.values()))
            order = np.argsort(-idf[_term(own)], kind="stable")
            counted = np.cumsum(times[order])
            rare = order[: int(np.searchsorted(counted, x.size - int(_SPARED * loose * x.size))) + 1]
            words.append(own[rare]), owners.append(np.full(len(rare), i))
            self.needs[i] = loose * x.size - (x.size - times[rare].sum())
        words, owners = np.concatenate(words), np.concatenate(owners)
        order = np.lexsort((owners, words))
        self.vocabulary, at = np.unique(words[order], return_index=True)
        self.holders, self.holders_at = owners[order], np.append(at, len(words))
        self.groups = []
        for width, inside in ((_NARROW, lambda size: size <= _SHORT), (_WIDE, lambda size: size > _SHORT)):
            chosen = sorted((i for i, x in enumerate(items) if inside(x.size)), key=lambda i: items[i].size)  # equal reaches are neighbours
            for at in range(0, len(chosen), _COLUMNS):  # so many items' counts are held at a time
                few = chosen[at : at + _COLUMNS]
                pieces = [_pieces(rows[i], width) for i in few]
                ends = np.cumsum([len(p) for p in pieces])
                sizes = np.array([items[i].size for i in few])
                self.groups.append((width, np.array(few), np.concatenate(pieces), ends, sizes))

    def _hits(self, words: np.ndarray, begin: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and block of all words of the texts that are an item's rarer words."""
        place = np.searchsorted(self.vocabulary, words)
        place[place == len(self.vocabulary)] = 0
        known = np.flatnonzero(self.vocabulary[place] == words)
        place = place[known]
        text = np.searchsorted(begin, known, side="right") - 1
        block = first[text] + (known - begin[text]) // _BLOCK
        many = self.holders_at[place + 1] - self.holders_at[place]
        at = np.repeat(self.holders_at[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.holders[at], np.repeat(block, many)

    def search(self, words: np.ndarray, begin: np.ndarray) -> list[list[dict]]:
        """Per text, the items found in it."""
        found: list[dict[int, dict]] = [{} for _ in range(len(begin) - 1)]
        blocks, first = _project(words, begin, self.basis)
        if not len(blocks):
            return [[] for _ in found]
        hit_item, hit_block = self._hits(words, begin, first)
        starts, _ = _blocks(begin)
        ends = np.repeat(begin[1:], np.diff(first))
        local = np.empty(len(self.items), np.int64)
        passages = {}
        for width, chosen, vectors, ends_of, sizes in self.groups:
            if width not in passages:
                passages = {width: _passages(blocks, first, width)}
            vector, owner = passages[width]
            local[:] = -1
            local[chosen] = np.arange(len(chosen))
            own = local[hit_item] >= 0
            counts = np.zeros((len(blocks) + 1, len(chosen)), np.uint16)  # differences of running sums are right though sums wrap
            np.add.at(counts, (hit_block[own] + 1, local[hit_item[own]]), np.uint16(1))
            np.cumsum(counts, axis=0, out=counts)
            reaches, begins = (v.tolist() for v in np.unique(-(-sizes // _BLOCK), return_index=True))  # blocks the judge may read on either side
            needs = np.ceil(self.needs[chosen] - 1e-9).astype(np.uint16)
            near = [(k, lo, hi, np.ascontiguousarray(counts[:, lo:hi])) for k, lo, hi in zip(reaches, begins, [*begins[1:], len(chosen)])]
            for s in range(0, len(vector), 4096):
                e = min(s + 4096, len(vector))
                cos = vector[s:e] @ vectors.T
                at, of_text = np.arange(s, e), owner[s:e]
                enough = np.zeros((e - s, len(chosen)), bool)
                for k, lo, hi, few in near:
                    # the rarer words around the passage that are the item's: with all its other words no common subsequence is longer
                    left, right = np.maximum(at - k, first[of_text]), np.minimum(at + width + k, first[of_text + 1])
                    np.greater_equal(few.take(right, axis=0) - few.take(left, axis=0), needs[lo:hi], out=enough[:, lo:hi])
                length = np.minimum(width * _BLOCK, ends[s:e] - starts[s:e])
                row, col = np.divmod(np.flatnonzero(enough), len(chosen))
                for r, c in zip(row.tolist(), col.tolist()):
                    best = float(cos[r, ends_of[c - 1] if c else 0 : ends_of[c]].max())
                    if best >= self.cosine:
                        self._judge(words, begin, int(of_text[r]), int(starts[s + r]), int(length[r]), int(chosen[c]), best, found)
        return [[x for _, x in sorted(f.items())] for f in found]

    def _judge(self, words, begin, doc: int, start: int, length: int, item: int, cos: float, found) -> None:
        """Compare an item with a passage and its surroundings."""
        x = self.items[item]
        low, high = max(int(begin[doc]), start - x.size), min(int(begin[doc + 1]), start + length + x.size)
        near = words[low:high].tolist()
        if sum(x.times[w] for w in x.times.keys() & set(near)) < self.loose * x.size:  # no subsequence is longer
            return
        common = x.common(near) / x.size
        if common < self.loose:
            return
        answer = x.common(near, x.answer_from) / (x.size - x.answer_from)
        if common >= self.exact or answer >= self.loose:
            old = found[doc].get(item)
            if old is None or (common, cos) > (old["common"], old["cosine"]):
                found[doc][item] = {"item_id": x.id, "cosine": cos, "common": common, "answer": answer, "at": low - int(begin[doc])}


@dataclass
class Corpus:
    """What all blocks of the query set need of the documents: counts and sums of signs of terms over all blocks of words, and the rows to fit on."""

    counts: np.ndarray
    blocks: int
    signs: np.ndarray
    rows: DataFrame


def _counted(rows: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    told = rows.select("text").mapInArrow(_count, _SLICE).groupBy("slice").applyInArrow(_add_slices, _SLICE).collect()
    counts, signs = np.zeros(_TERMS), np.zeros((_TERMS, _DIRECTIONS))
    for r in told:
        counts.reshape(_SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], np.int64)
        signs.reshape(_SLICES, -1)[r["slice"]] = np.frombuffer(r["signs"], np.float32)
    return counts, sum(r["blocks"] for r in told), signs


def counted(docs: DataFrame, fit_rows: int | None = None) -> Corpus:
    counts, blocks, signs = _counted(docs)
    texts = docs.select("text")
    if fit_rows is None:
        return Corpus(counts, blocks, signs, texts)
    share = fit_rows / max(1, texts.count())
    place = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20))
    few = texts if share >= 1 else docs.select("text", place.alias("place")).where(F.col("place") < int(share * (1 << 20))).select("text")
    rows = written(few, "latent-rows")
    return Corpus(counts, blocks, _counted(rows)[2], rows)


def fit(corpus: Corpus, items: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    """Terms x latent directions, with IDF and singular values worked in, and the IDF; None without any words."""
    spark = corpus.rows.sparkSession
    own, own_begin = _words(items.column("text"))
    counts = corpus.counts + np.bincount(_term(own), minlength=_TERMS)
    idf = np.log((corpus.blocks + len(own_begin) + 1) / (counts + 1)).astype(np.float32)
    y = corpus.signs.copy()
    _spread(own, own_begin, y)
    y *= idf[:, None]
    if not np.abs(y).sum():
        return None
    q = np.linalg.qr(y)[0]
    basis = (q * idf[:, None]).astype(np.float32)
    shared_basis = spark.sparkContext.broadcast(basis)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in (p for b in batches for p in chunks(b)):
            rows, _ = _project(*_words(part.column("text")), shared_basis.value)
            if len(rows):
                rows = rows.astype(np.float64)
                total = rows.T @ rows if total is None else total + rows.T @ rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["k", "sums"])

    def add_gram(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
        return pa.table({"k": pa.array([0], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    rows, _ = _project(own, own_begin, basis)
    g = rows.astype(np.float64).T @ rows
    for r in corpus.rows.mapInArrow(gram, "k long, sums binary").groupBy("k").applyInArrow(add_gram, "k long, sums binary").collect():
        g = g + np.frombuffer(r["sums"], np.float64).reshape(g.shape)
    values, vectors = np.linalg.eigh(g)
    keep = np.argsort(-values)[:_LATENT]
    keep = keep[values[keep] > 1e-9 * values.max()]
    return (basis @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32), idf


def mark(
    docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, exact: float = 0.8, loose: float = 0.6, fit_rows: int | None = None,
) -> DataFrame:
    """``docs`` (with a ``text``) and ``leaks``: per item found its id, cosine, shared part, part of the answer and place (words).

    The latent space is that of all rows, unless a caller asks for about ``fit_rows`` of them.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    shape = LEAKS.format(id=kind)
    columns = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("leaks", F.array().cast(shape))
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    blocks = max(1, -(-items.count() // _ITEMS))
    corpus = None
    for b in range(blocks):  # a bounded block of the query set at a time
        chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        words, begin = _words(chosen.column("text"))
        ready = [_Item(i, words[begin[k] : begin[k + 1]]) for k, i in enumerate(chosen.column("item_id").to_pylist())]
        long_enough = [k for k, x in enumerate(ready) if x.size >= 5]
        if not long_enough:
            continue
        corpus = corpus or counted(docs, fit_rows)
        fitted = fit(corpus, chosen)
        if fitted is None:
            continue
        basis, idf = fitted
        rows, first = _project(words, begin, basis)
        vectors = [rows[first[k] : first[k + 1]] for k in long_enough]
        searcher = docs.sparkSession.sparkContext.broadcast(Searcher(basis, idf, [ready[k] for k in long_enough], vectors, cosine, exact, loose))

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            for part in (p for whole in batches for p in chunks(whole)):
                more = searcher.value.search(*_words(part.column("text")))
                place = part.schema.get_field_index("leaks")
                had = part.column(place).to_pylist()
                leaks = pa.array([a + b for a, b in zip(had, more)], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), leaks)

        out = out.mapInArrow(run, out.schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and item found in it: ``doc_id`` and what :func:`mark` tells."""
    return mark(docs.select("doc_id", "text"), benchmark, **options).select("doc_id", F.inline("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no item was found, with their columns."""
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return mark(row, benchmark, **options).where(F.size("leaks") == 0).select("_row.*")
