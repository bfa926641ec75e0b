"""Ranked lexical search by MaxScore with bounds of term pairs.

The texts are read once: per document its length and the counts of the terms that the items
hold are kept as a forward index (a bitmap of fixed size lets them through; terms are recognised by 64-bit hashes).
Corpus counts come from it.  Items are taken in blocks of bounded size; per block
the forward index becomes an inverted index, one row per some thousand documents, with

* every term's list of documents and impacts, and its greatest impact;
* for pairs of terms of one item whose rarer one is rare, the greatest sum of both impacts in a document, and the ``k`` documents
  of the greatest sums.  Pairs that are rare and not listed have no common document.

Thresholds first: in every part of the index the best documents of an item's pair lists are scored; the
tenth best score over all parts is one that the answer's tenth reaches.  Then every part is searched:
lists go from the greatest impact on, until the greatest impacts of the rest together stay below the
threshold.  A document of a list has its impact there, and from every later term no more than that term's
greatest impact, and no more than the pair's greatest sum leaves over its impact here, nothing
where the pair has no document.  Only documents that can still reach the threshold are scored in full.  Equal scores pass, so that ids
can decide.  Each part returns at most ten documents an item.

Null texts have no terms.  Rows of one item_id are one item with the terms of all.  Repeated rows of
documents count, and are ranked, each; rows without doc_id come after others of the same score.
Items without terms, or whose terms no document holds, have no rows; so have empty
tables.  Very long texts are read in one piece, a few megabytes at a time beside others.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.llm.common import chunks, text_bytes, word_hashes
from signalloom.session import discard, written

_BITS = 1 << 22  # places of the bitmap of terms
_BLOCK_TERMS, _BLOCK_ITEMS = 1 << 17, 1024  # of a block of items (one item at least)
_PART_ROWS, _PART_POSTINGS = 512, 1 << 16  # of a part of the index, a row of under 1 MB; documents are numbered with 16 bits
_MEETINGS = 1 << 18  # pairs of terms looked up at a time
_RARE = 64  # a pair is listed where its rarer term is in no more than a part of so many of the documents

#: Bytes that part terms: ASCII but digits and letters.
_OUTSIDE = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _OUTSIDE[_low : _high + 1] = True

_FORWARD = "doc_id {id}, n long, terms binary, counts binary"
_INDEX = "docs array<{id}>, terms binary, at binary, rows binary, impacts binary, a binary, b binary, pair_at binary, pair_rows binary, pair_most binary"


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found, begins = word_hashes(*text_bytes(column), _OUTSIDE)
    return found.view(np.int64), begins


def _counted(bitmap: np.ndarray):
    """Texts to their length in terms and the counts of terms that the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, limit=1 << 20)):
            found, begins = _terms(batch.column("text"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            some = np.flatnonzero(bitmap[found & (_BITS - 1)])
            order = some[np.lexsort((found[some], owner[some]))]
            term, doc = found[order], owner[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.zeros(0, np.int64)
            counts = np.diff(np.append(first, len(term))).astype("<i4")
            at = np.searchsorted(doc[first], np.arange(batch.num_rows + 1))
            kept = term[first].astype("<i8")
            rows = [(kept[s:e].tobytes(), counts[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(begins), pa.int64()), *(pa.array(c, pa.binary()) for c in ([r[0] for r in rows], [r[1] for r in rows]))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return run


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes in a row, and how many each row has."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, df = np.unique(_joined(batch.column("terms"), "<i8")[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df, pa.int64())], names=["term", "df"])


@dataclass
class Block:
    """A block of items: their terms' weights, and which terms meet in an item."""

    items: list  # item_id
    own: list[np.ndarray]  # per item the places of its terms in ``terms``
    terms: np.ndarray  # sorted
    weights: np.ndarray
    rare: np.ndarray
    documents: int
    length: int

    def partners(self) -> tuple[np.ndarray, np.ndarray]:
        """For every rare term the terms it meets in an item, one after another, and the places where they begin."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own in self.own:
            rare = own[self.rare[own]]
            left.append(np.repeat(rare, len(own))), right.append(np.tile(own, len(rare)))
        a, b = np.concatenate(left), np.concatenate(right)
        # of two rare terms one listing is enough
        keep = (a != b) & (~self.rare[b] | (a < b))
        pairs = np.unique(a[keep] * len(self.terms) + b[keep])
        return pairs % max(len(self.terms), 1), np.searchsorted(pairs, np.arange(len(self.terms) + 1) * len(self.terms))


def _weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _impacts(block: Block, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    if 90 * int(n.max(initial=0)) * block.documents < 2**63:
        m = 10 + (90 * n * block.documents) // block.length
    else:
        m = np.array([10 + 90 * int(x) * block.documents // block.length for x in n], np.int64)
    return block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def _inverted(block: Block, k: int = 10):
    """Rows of the forward index to parts of the inverted index, with the ``k`` leading documents of every pair of terms."""
    partner, partner_at = block.partners()
    size = max(len(block.terms), 1)

    def part(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        term, sizes = _joined(table.column("terms"), "<i8")
        tf, _ = _joined(table.column("counts"), "<i4")
        owner = np.repeat(np.arange(table.num_rows), sizes)
        place = np.searchsorted(block.terms, term)
        known = block.terms[np.minimum(place, size - 1)] == term if len(block.terms) else np.zeros(len(term), bool)
        owner, place, tf = owner[known], place[known], tf[known].astype(np.int64)
        impact = _impacts(block, table.column("n").to_numpy(), owner, place, tf)
        some = impact > 0
        owner, place, impact = owner[some], place[some], impact[some]
        keys = owner * size + place  # ascending: documents in turn, their terms sorted
        # pairs: every document of a rare term against the terms it meets in an item
        rare = np.flatnonzero(block.rare[place])
        many = partner_at[place[rare] + 1] - partner_at[place[rare]]
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()), _MEETINGS)), len(rare)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s, e in zip(cuts[:-1], cuts[1:]):
            left, right = np.repeat(rare[s:e], many[s:e]), partner[_spans(partner_at[place[rare[s:e]]], many[s:e])]
            wanted = owner[left] * size + right
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            both = keys[at] == wanted
            found.append((left[both], right[both], at[both]))
        left, right, at = map(np.concatenate, zip(*found))
        sums = impact[left] + impact[at]
        order = np.lexsort((owner[left], -sums, right, place[left]))
        left, right, sums = left[order], right[order], sums[order]
        pair = place[left] * size + right
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        listed = np.diff(np.append(first, len(pair)))
        leading = np.arange(len(pair)) - np.repeat(first, listed) < k  # what pairs tell of the others is their greatest sum
        by_term = np.lexsort((owner, place))
        lists = np.searchsorted(place[by_term], np.arange(size + 1))
        there = np.flatnonzero(np.diff(lists) > 0)
        values = [
            there.astype("<i4"), np.append(lists[there], len(by_term)).astype("<i4"), owner[by_term].astype("<u2"), impact[by_term].astype("<i8"),
            place[left[first]].astype("<i4"), right[first].astype("<i4"), np.append(0, np.cumsum(np.minimum(listed, k))).astype("<i4"),
            owner[left[leading]].astype("<u2"), sums[first].astype("<i8"),
        ]
        docs = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks())
        names = ["docs", "terms", "at", "rows", "impacts", "a", "b", "pair_at", "pair_rows", "pair_most"]
        return pa.RecordBatch.from_arrays([docs, *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                piece = batch.slice(s, 512)
                held.append(piece)
                rows += piece.num_rows
                postings += sum(len(x.as_buffer()) // 8 for x in piece.column("terms"))
                if rows >= _PART_ROWS or postings >= _PART_POSTINGS:
                    yield part(held)
                    held, rows, postings = [], 0, 0
        if held:
            yield part(held)

    return run


class Part:
    """A part of the inverted index, as its lists."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

        self.terms, self.at, self.rows, self.impacts = numbers("terms", "<i4"), numbers("at", "<i4"), numbers("rows", "<u2"), numbers("impacts", "<i8")
        self.a, self.b, self.pair_at = numbers("a", "<i4"), numbers("b", "<i4"), numbers("pair_at", "<i4")
        self.pair_rows, self.pair_most = numbers("pair_rows", "<u2"), numbers("pair_most", "<i8")
        self.docs = batch.column("docs")[i].values
        self.most = np.maximum.reduceat(self.impacts, self.at[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        self.size = int(max(self.terms.max(initial=0), self.b.max(initial=0), self.a.max(initial=0))) + 1
        self.pairs = self.a.astype(np.int64) * self.size + self.b
        ids = self.docs.to_numpy(zero_copy_only=False) if self.docs.null_count == 0 and pa.types.is_integer(self.docs.type) else np.array(self.docs.to_pylist(), object)
        order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r])) if ids.dtype == object else np.argsort(ids, kind="stable")
        self.place = np.empty(len(ids), np.int64)  # of the document by id
        self.place[order] = np.arange(len(ids))

    def lists(self, own: np.ndarray) -> np.ndarray:
        """Which lists an item's terms have here."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        return at[self.terms[at] == own]

    def list(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[self.at[i] : self.at[i + 1]], self.impacts[self.at[i] : self.at[i + 1]]

    def pair(self, terms: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The listing of pairs of terms, -1 where there is none."""
        if not len(self.pairs):
            return np.full(len(terms), -1)
        out = np.full(len(terms), -1)
        for a, b in ((terms, others), (others, terms)):
            key = a.astype(np.int64) * self.size + b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == key, at, out)
        return out

    def scores(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Full scores of sorted rows."""
        total = np.zeros(len(rows), np.int64)
        for i in lists:
            held, impact = self.list(i)
            if len(held) < len(rows):
                at = np.minimum(np.searchsorted(rows, held), len(rows) - 1)
                hit = rows[at] == held
                total[at[hit]] += impact[hit]
            else:
                at = np.minimum(np.searchsorted(held, rows), len(held) - 1)
                total += np.where(held[at] == rows, impact[at], 0)
        return total

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.place[rows], -score))[:k]


def _thresholds(block: Block, k: int):
    """Parts to ``item, score``: the scores of the k documents that lead the item's pair lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, items, scores = Part(batch, i), [], []
                for item, own in enumerate(block.own):
                    lists = part.lists(own)
                    terms = part.terms[lists]
                    a, b = np.triu_indices(len(terms), 1)
                    found = part.pair(terms[a], terms[b])
                    found = found[found >= 0]
                    if not len(found):
                        continue
                    # of so many of the lists of the greatest sums the leading documents
                    lead = found[np.argsort(-part.pair_most[found], kind="stable")[:k]]
                    rows = [part.pair_rows[s:e] for s, e in zip(part.pair_at[lead], part.pair_at[lead + 1])]
                    rows = np.unique(np.concatenate(rows))
                    top = np.sort(part.scores(rows, lists))[::-1][:k]
                    items.append(np.full(len(top), item)), scores.append(top)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int64()), pa.array(np.concatenate(scores), pa.int64())], names=["item", "score"])

    return run


def candidates(part: Part, lists: np.ndarray, least: int, rare: np.ndarray) -> np.ndarray:
    """Sorted rows that can reach ``least``."""
    order = lists[np.argsort(-part.most[lists], kind="stable")]
    most, terms = part.most[order], part.terms[order]
    rest = np.cumsum(most[::-1])[::-1]
    found = []
    for k in range(int((rest >= least).sum())):
        rows, impact = part.list(order[k])
        later, bound = terms[k + 1 :], most[k + 1 :]
        if len(later):
            pair = part.pair(np.full(len(later), terms[k]), later)
            told = (pair >= 0) | rare[later] | rare[terms[k]]  # not listed although rare: no common document
            joint = np.where(pair >= 0, part.pair_most[np.maximum(pair, 0)] if len(part.pair_most) else 0, 0)
            free = int(bound[~told].sum())
            bound, joint = bound[told & (joint > 0)], joint[told & (joint > 0)]
            reach = impact + free
            if len(bound):
                reach = reach + np.clip(joint[None] - impact[:, None], 0, bound[None]).sum(1)
            rows = rows[reach >= least]
        else:
            rows = rows[impact >= least]
        if len(rows):
            found.append(rows)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def _searched(block: Block, least: np.ndarray, k: int):
    """Parts to ``item, doc_id, score``: every part's k best documents that reach the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i)
                items, rows, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for item, own in enumerate(block.own):
                    lists = part.lists(own)
                    if not len(lists) or part.most[lists].sum() < least[item]:
                        continue
                    held = candidates(part, lists, least[item], block.rare)
                    if not len(held):
                        continue
                    score = part.scores(held, lists)
                    enough = score >= least[item]
                    held, score = held[enough], score[enough]
                    top = part.best(held, score, k)
                    items.append(np.full(len(top), item)), rows.append(held[top]), scores.append(score[top])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(items), pa.int64()), part.docs.take(pa.array(np.concatenate(rows), pa.int64())), pa.array(np.concatenate(scores), pa.int64())],
                    names=["item", "doc_id", "score"],
                )

    return run


def _item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms``: the distinct terms of all rows of an item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, begins = _terms(batch.column("text"))
            terms = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms], names=["item_id", "terms"])

    told = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<long>")
    return told.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("terms")))).alias("terms")).where(F.size("terms") > 0)


def _item_blocks(items: DataFrame) -> Iterator[list]:
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and (len(held) == _BLOCK_ITEMS or size + len(row["terms"]) > _BLOCK_TERMS):
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row["terms"])
    if held:
        yield held


def _block(spark: SparkSession, rows: list, frequency: DataFrame, documents: int, length: int) -> Block:
    """The block's terms with their weights; its terms are few enough to be joined as a small table."""
    terms = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]))
    asked = spark.createDataFrame(pa.table({"term": terms}))
    found = frequency.join(F.broadcast(asked), "term").toArrow()
    df = dict(zip(found.column("term").to_pylist(), found.column("df").to_pylist()))
    held = np.array([df.get(t, 0) for t in terms.tolist()], np.int64)
    weights = np.array([_weight(documents, d) if d else 0 for d in held.tolist()], np.int64)
    own = [np.searchsorted(terms, np.unique(np.array(r["terms"], np.int64))) for r in rows]
    return Block([r["item_id"] for r in rows], own, terms, weights, held * _RARE <= documents, documents, length)


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``doc_id, text`` and ``item_id, text`` to ``item_id, rank, doc_id, score``: every item's k best documents."""
    spark = docs.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    result = T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())])
    asked = written(_item_terms(items), "search-items")
    bits = asked.select(F.explode("terms").alias("t")).select(F.col("t").bitwiseAND(F.lit(_BITS - 1)).alias("b")).distinct().toArrow()  # at most _BITS rows
    bitmap = np.zeros(_BITS, bool)
    bitmap[bits.column("b").to_numpy()] = True
    name = doc_kind.simpleString()
    forward = written(docs.select("doc_id", "text").mapInArrow(_counted(bitmap), _FORWARD.format(id=name)), "search-forward")
    documents, length = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return spark.createDataFrame([], result)
    counted = forward.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    frequency = written(counted, "search-frequencies")

    answers = []
    for rows in _item_blocks(asked):
        block = _block(spark, rows, frequency, documents, length)
        index = written(forward.mapInArrow(_inverted(block, k), _INDEX.format(id=name)), "search-index")
        best = Window.partitionBy("item").orderBy(F.desc("score"))
        lead = index.mapInArrow(_thresholds(block, k), "item long, score long").withColumn("place", F.row_number().over(best))
        least = np.ones(len(block.items), np.int64)  # scores are above 0
        for row in lead.where(F.col("place") == k).collect():  # a row an item of the block
            least[row["item"]] = max(row["score"], 1)
        found = index.mapInArrow(_searched(block, least, k), f"item long, doc_id {name}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.items)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_kind)]))
        named = top.join(F.broadcast(names), "item")  # _BLOCK_ITEMS rows
        answers.append(written(named.select("item_id", "rank", "doc_id", "score"), "search-answer"))
        discard(index)
    if not answers:
        return spark.createDataFrame([], result)
    return spark.read.schema(result).parquet(*[a._written_to for a in answers])
