"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

Every window of ``length`` bytes has an anchor: the least of the hashes of its short grams,
the leftmost on ties.  Equal windows have equal anchors at equal places, so anchors that occur
once in all documents rule their windows out.  Windows that follow each other with the same
anchor make one context, a stretch of under two lengths.  Contexts that are equal as a
whole are repeated as a whole.  What is left are different contexts with a common anchor,
where only some windows may be repeated; contexts that share neither half a window to the
left nor to the right of their anchor with another one hold none.

Those contexts, in bounded lots, are cut into shards; each shard's suffixes are sorted on their
own into a Burrows-Wheeler transform.  The transforms are merged by interleave refinement: an
array says which shard's row stands at each place of the merged transform, and one stable
sort by the preceding symbols (up to eight at a time) refines it from the order by k symbols
to that by k + 8.  Borders that appear between rows are the ends of their common prefixes; rows alone
between two borders leave, and blocks that are left at ``length`` symbols are the repeated
intervals.  No suffix of the whole is sorted again.  Where one anchor has more contexts than a lot should hold, its windows are compared
by their 128-bit hashes instead, in an aggregation that spreads over all tasks.

A byte goes if a repeated window covers it; windows are judged on the input.  Texts under
``length`` bytes, empty and null ones lose nothing (null: no bytes).  Repeated rows repeat
each other.  Gram and context hashes have 64 bits each and are only compared together.  Texts of any length are
judged whole.  Other columns, whatever their names, are not read.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import chunks, mix, power, text_bytes
from signalloom.session import written

_GRAM, _LOT, _SHARD, _CROWD = 24, 1 << 18, 1 << 16, 4096
_CODES = np.random.RandomState(20260102).randint(0, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) | np.uint64(1)

def _sums(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Running sums from which the hash of any stretch is a difference."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[which][raw] * power(False, len(raw)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * power(True, len(sums))[start])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    rows = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def _contexts(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per context: text, first window, windows, the anchor's place, its hash and the context's."""
    sizes = np.diff(offsets)
    texts = np.flatnonzero(sizes >= length)
    if not len(texts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums = _sums(raw)
    grams = np.arange(len(raw) - _GRAM + 1)
    hashes = _hash(sums, grams, grams + _GRAM)
    # hash above, place below: ties go to the leftmost
    least = _sliding_least((hashes & ~np.uint64(2**31 - 1)) | grams.astype(np.uint64), length - _GRAM + 1)
    windows = sizes[texts] - length + 1
    text = np.repeat(texts, windows)
    at = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(windows)[:-1]), windows) + offsets[text]
    anchor = (least[at] & np.uint64(2**31 - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(text) != 0)))
    count = np.diff(np.append(first, len(at)))
    start, place = at[first], anchor[first]
    whole = _hash(sums, start, start + count + length - 1)
    whole = mix(whole + (place - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64))
    return text[first], start - offsets[text[first]], count, place - start, hashes[place], whole


# ---- transforms ------------------------------------------------------------------------
def _sorted_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Rotations of the symbols in order of at least ``length`` of them.

    Seven symbols make a first key; known ranks double it until it is long enough.
    """
    n = len(symbols)
    round_ = np.resize(symbols, n + 7).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | round_[j : j + n]
    order = np.argsort(key, kind="stable")
    change = np.append(True, np.diff(key[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(change)[np.cumsum(change) - 1]
    known = 7
    while known < length:
        todo = np.flatnonzero(~(np.append(change[1:], True) & change))  # places in the order whose rank is shared
        if not len(todo):
            break
        at = order[todo]
        after, group = rank[(at + known) % n], rank[at]
        again = np.lexsort((after, group))
        order[todo] = at[again]
        fresh = np.append(True, (np.diff(group[again]) != 0) | (np.diff(after[again]) != 0))
        change[todo] = fresh
        # a rank is the place of its group's first member
        rank[order[todo]] = todo[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        known *= 2
    return order


def _grams(symbols: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` symbols from each place on, round the end, as one number."""
    n = len(symbols)
    round_ = np.resize(symbols, n + step).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(step):
        out = out * np.uint64(256) + round_[j : j + n]
    return out


def _steps(shards: list[np.ndarray], length: int, largest_symbol: int) -> tuple[int, list[np.ndarray]]:
    """How many symbols a round can take so that their combinations fit 16 bits, and their numbers by place."""
    for step in (8, 4, 2):
        if length % step == 0 and largest_symbol < 256:
            values, code = np.unique(np.concatenate([_grams(x, step) for x in shards]), return_inverse=True)
            if len(values) <= 1 << 16:
                return step, np.split(code.astype(np.uint16), np.cumsum([len(x) for x in shards])[:-1])
    return 1, [x.astype(np.uint16) for x in shards]


def _transform(symbols: np.ndarray, codes: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's sorted rotations, the ``step`` symbols before each row, and the row that begins with them."""
    order = _sorted_suffixes(symbols, length)
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    return order, codes[order - step], row[order - step]


def _merge(transforms: list[tuple[np.ndarray, np.ndarray, np.ndarray]], step: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (numbered shard by shard) that agree with another one in ``length`` symbols, and their blocks.

    ``row`` is the interleave: rows of all shards in merged order.  A round puts the rows that
    begin one step earlier in stable order of that step's symbols; rows alone in their block
    stay alone however the string goes on to the left, and leave.
    """
    base = np.append(0, np.cumsum([len(t[0]) for t in transforms]))
    before = np.concatenate([t[1] for t in transforms])
    earlier = np.concatenate([t[2].astype(np.int64) + b for t, b in zip(transforms, base)]).astype(np.int32)
    row, block = np.arange(base[-1], dtype=np.int32), np.zeros(base[-1], np.int32)
    for _ in range(length // step):
        if not len(row):
            break
        symbol = before[row]
        order = np.argsort(symbol, kind="stable")
        row, block, symbol = earlier[row[order]], block[order], symbol[order]
        change = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        together = ~(change & np.append(change[1:], True))
        row, block = row[together], np.cumsum(change, dtype=np.int32)[together]
    return row, block


def repeated_windows(strings: list[bytes], windows: np.ndarray, weights: np.ndarray, length: int, shard_bytes: int = _SHARD) -> list[np.ndarray]:
    """Which of each string's first ``windows`` windows occur twice or more; a string stands for ``weights`` equal ones."""
    sizes = np.array([len(s) for s in strings])
    base = np.append(0, np.cumsum(sizes + 1))
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    inside = np.ones(len(data), bool)
    inside[base[1:] - 1] = False
    used = np.unique(data[inside])  # symbols are places among the bytes that occur; 0 ends a string
    place = np.zeros(256, np.uint16)
    place[used] = np.arange(1, len(used) + 1)
    symbols = np.where(inside, place[data], 0).astype(np.uint16)
    shards, begins, at = [], [], 0
    while at < len(strings):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), shard_bytes, side="right")))
        shards.append(symbols[base[at] : base[min(upto, len(strings))]])
        begins.append(base[at])
        at = upto
    step, codes = _steps(shards, length, len(used))
    transforms = [_transform(x, c, length, step) for x, c in zip(shards, codes)]
    suffixes = [t[0] + b for t, b in zip(transforms, begins)]
    row, block = _merge(transforms, step, length)
    start = np.concatenate(suffixes)[row]
    owner = np.searchsorted(base, start, side="right") - 1
    own = start - base[owner] < windows[owner]  # each window belongs to one context only
    start, owner, block = start[own], owner[own], block[own]
    total = np.bincount(block, weights=weights[owner]) if len(block) else np.zeros(0)
    again = np.zeros(int(base[-1]), bool)
    again[start[total[block] >= 2]] = True
    again |= np.repeat(weights >= 2, sizes + 1)
    return [again[base[i] : base[i] + windows[i]] for i in range(len(strings))]


# ---- jobs ------------------------------------------------------------------------------
_KEY = ("doc_id", "th")
_RANGES = "array<struct<a:int,b:int>>"


def _spans(flags: np.ndarray, start: int) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": start + int(a), "b": start + int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]


def _find_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in chunks(b)):
            text, start, count, place, anchor, whole = _contexts(*text_bytes(part.column("text")), length)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(text)) for c in _KEY), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(place.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                names=[*_KEY, "start", "count", "place", "anchor", "whole"],
            )

    return run


def _cut(length: int):
    """Texts with the places of contexts to the contexts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in chunks(b)):
            out: dict[str, list] = {c: [] for c in ("anchor", "start", "count", "place", "n", "crowded", "row")}
            data = []
            for i, (text, asked) in enumerate(zip(part.column("text").to_pylist(), part.column("asked").to_pylist())):
                raw = text.encode("utf-8", "surrogatepass")
                for c in asked:
                    data.append(raw[c["start"] : c["start"] + c["count"] + length - 1])
                    out["row"].append(i)
                    for k in ("anchor", "start", "count", "place", "n", "crowded"):
                        out[k].append(c[k])
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(rows) for c in _KEY), pa.array(out["anchor"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["count"], pa.int32()), pa.array(out["place"], pa.int32()),
                 pa.array(out["n"], pa.int64()), pa.array(out["crowded"], pa.bool_()), pa.array(data, pa.binary())],
                names=[*_KEY, "anchor", "start", "count", "place", "n", "crowded", "bytes"],
            )

    return run


def _merge_lots(length: int, lot_bytes: int, shard_bytes: int):
    """Contexts sorted by anchor to the repeated windows of those that occur once."""

    half = (length - _GRAM) // 2

    def sides(r: dict) -> list[tuple]:
        """Half a window on either side of the anchor, where the context reaches that far: equal windows agree on one."""
        data, at = r["bytes"], r["place"]
        left = [(r["anchor"], 0, data[at - half : at])] if at >= half else []
        return left + ([(r["anchor"], 1, data[at + _GRAM : at + _GRAM + half])] if len(data) >= at + _GRAM + half else [])

    def solve(rows: list[dict]) -> Iterator[dict]:
        halves = [sides(r) for r in rows]
        times = Counter()
        for r, keys in zip(rows, halves):
            for key in keys:
                times[key] += r["n"]
        rows = [r for r, keys in zip(rows, halves) if any(times[key] > 1 for key in keys)]
        if not any(r["n"] == 1 for r in rows):
            return
        found = repeated_windows(
            [r["bytes"] for r in rows], np.array([r["count"] for r in rows]), np.array([r["n"] for r in rows], np.float64), length, shard_bytes
        )
        for r, flags in zip(rows, found):
            if r["n"] == 1 and flags.any():
                yield {"doc_id": r["doc_id"], "th": r["th"], "ranges": _spans(flags, r["start"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, out, shape = 0, [], None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field("doc_id"), batch.schema.field("th"), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
            for row in batch.to_pylist():
                if size >= lot_bytes and row["anchor"] != held[-1]["anchor"]:  # an anchor's contexts stay together
                    out += solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
            if out:
                yield pa.RecordBatch.from_pylist(out, shape)
                out = []
        if held and (out := list(solve(held))):
            yield pa.RecordBatch.from_pylist(out, shape)

    return run


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, ones, twos = [], [], [], []
            for i, (data, count) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("count").to_pylist())):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(count)
                rows.append(np.full(count, i)), ats.append(at)
                ones.append(_hash(_sums(raw, 0), at, at + length)), twos.append(_hash(_sums(raw, 1), at, at + length))
            if not rows:
                continue
            row = pa.array(np.concatenate(rows))
            start = batch.column("start").take(row).to_numpy() + np.concatenate(ats)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in _KEY), pa.array(start.astype(np.int32)), batch.column("n").take(row),
                 pa.array(np.concatenate(ones).view(np.int64)), pa.array(np.concatenate(twos).view(np.int64))],
                names=[*_KEY, "at", "n", "one", "two"],
            )

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in chunks(b)):
            removed, spans, kept = [], [], []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                edge = np.zeros(len(raw) + 1, np.int64)
                flat = [(r["a"], r["b"] + length) for group in ranges for r in group]
                np.add.at(edge, [a for a, _ in flat], 1)
                np.add.at(edge, [b for _, b in flat], -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in _KEY), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=[*_KEY, "n_removed", "n_spans", "kept"],
            )

    return run


def repeats(docs: DataFrame, length: int = 200, crowd: int = _CROWD, lot_bytes: int = _LOT, shard_bytes: int = _SHARD) -> DataFrame:
    """Documents that lose bytes: ``doc_id, th`` (a hash of the text), ``n_removed, n_spans, kept`` (the remaining bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").where(F.octet_length("text") >= length)
    key = f"doc_id {kind}, th long"
    rows = written(texts.mapInArrow(_find_contexts(length), f"{key}, start int, count int, place int, anchor long, whole long"), "bwt-contexts")
    again = rows.groupBy("anchor").agg(F.count("*").alias("times"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("times > 1")
    # written first: then both sides of the join are plain, and a part with a very common anchor can be split
    again = written(again.select("anchor", (F.col("low") < F.col("high")).alias("mixed")), "bwt-repeated")
    kept = written(rows.join(again, "anchor"), "bwt-anchored")

    one = F.min(F.struct(*_KEY, "start", "count", "place")).alias("at")
    contexts = kept.where("mixed").groupBy("anchor", "whole").agg(F.count("*").alias("n"), one).select("anchor", "whole", "n", "at.*")
    contexts = written(contexts, "bwt-distinct")
    open_ = contexts.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("least = 1")
    asked = contexts.join(open_.select("anchor", (F.col("size") > crowd).alias("crowded")), "anchor").groupBy(*_KEY).agg(
        F.collect_list(F.struct("anchor", "start", "count", "place", "n", "crowded")).alias("asked")
    )
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in _KEY]
    # a text's row may be repeated: contexts that stand for one row only come from rows that are not
    cut = texts.join(asked, same(texts, asked)).select(*(texts[c] for c in _KEY), "text", "asked")
    cut = written(cut.mapInArrow(_cut(length), f"{key}, anchor long, start int, count int, place int, n long, crowded boolean, bytes binary"), "bwt-cut")
    lots = cut.where("NOT crowded").repartition("anchor").sortWithinPartitions("anchor")
    partly = lots.mapInArrow(_merge_lots(length, lot_bytes, shard_bytes), f"{key}, ranges {_RANGES}")
    each = written(cut.where("crowded").mapInArrow(_window_hashes(length), f"{key}, at int, n long, one long, two long"), "bwt-crowded")
    often = each.groupBy("one", "two").agg(F.sum("n").alias("times")).where("times > 1").select("one", "two")
    single = each.where("n = 1").join(often, ["one", "two"]).select(*_KEY, F.array(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("ranges"))

    whole = contexts.where("n > 1").select("anchor", "whole")
    span = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") - 1).alias("b"))).cast(_RANGES).alias("ranges")
    full = kept.where("NOT mixed").select(*_KEY, span).union(kept.where("mixed").join(whole, ["anchor", "whole"]).select(*_KEY, span))
    ranges = full.union(partly).union(single).groupBy(*_KEY).agg(F.collect_list("ranges").alias("ranges"))
    done = texts.join(ranges, same(texts, ranges)).select(*(texts[c] for c in _KEY), "text", "ranges")
    return done.mapInArrow(_remove(length), f"{key}, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    lost = repeats(docs, length, **options).withColumn("sha", F.sha2("kept", 256)).drop("kept")
    lost = written(lost.dropDuplicates([*_KEY]), "bwt-removed")  # repeated rows have the same result
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    return own.join(lost, [own[c].eqNullSafe(lost[c]) for c in _KEY], "left").select(
        own["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"),
    )


