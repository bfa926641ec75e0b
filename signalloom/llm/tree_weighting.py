"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end.  Each is decomposed into binary decisions (end or
not, then eight bits), and each decision has a tree of contexts: the bytes before it, from
none to ``depth``; bytes before the start are the end symbol.  A node's zeros and ones
give a Krichevsky-Trofimov estimate, and its weighted probability is half that estimate and
half the product of its children's weighted probabilities.  The posterior of these halves,
down the path of a context, mixes the estimates of all depths into the probability of a
decision; contexts that training never saw end the path, and the weights along what was
seen are scaled to one.  Code length per byte is -score * log2(10) / bytes.

Counts come from all training texts: only runs of depth + 1 symbols are counted, and every
shallower node is a sum of deeper ones.  The whole tree is written.  Tasks hold its most frequent nodes, a
documented number of them: a decision whose path ends inside those is scored in the task.  Runs with any other decision
are looked up in the written tree by joins, depth by depth, so the scores do not depend on what tasks hold.  Words
likewise: the most frequent are looked up in the task, all others by a join.

Null texts are empty: they have an end only.  Rows without doc_id train as an empty name.
Repeated rows count repeatedly.  Without training rows every decision has probability 1/2.
Very long texts are read in chunks of rows, one row at least.  Other columns, whatever their names, are not read.  An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import chunks, mix, text_bytes, word_hashes
from signalloom.session import written

END, _SYMBOL = 256, 9
_CHUNK = 1 << 20  # bytes of text whose work arrays a task holds at a time
_WORD_END = 0x454E44  # the token after a text's last word


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


# ---- counting -----------------------------------------------------------------------
def _runs(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of depth + 1 symbols (the last one lowest), and the places where texts begin."""
    docs = len(offsets) - 1
    begin = offsets + np.arange(docs + 1)  # one end more per text
    symbols = np.full(len(raw) + docs, END, np.uint64)
    inside = np.ones(len(symbols), bool)
    inside[begin[1:] - 1] = False
    symbols[inside] = raw
    place = np.arange(len(symbols)) - np.repeat(begin[:-1], np.diff(begin))
    codes = symbols.copy()
    for j in range(1, depth + 1):
        before = np.full(len(symbols), END, np.uint64)
        before[j:] = symbols[:-j] if j < len(symbols) else before[j:]
        before[place < j] = END
        codes |= before << np.uint64(_SYMBOL * j)
    return codes.view(np.int64), begin


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
                    kinds = np.full(len(keys), kind, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])
                    parts.clear()

        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                raw, offsets = text_bytes(part.column("text"))
                codes, _ = _runs(raw, offsets, depth)
                words, _ = word_hashes(raw, offsets)
                for kind, keys in ((0, codes), (1, words.view(np.int64))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    size += len(held[kind][-1][0])
                held[1].append((np.array([_WORD_END], np.int64), np.array([part.num_rows], np.int64)))
                if size > 3_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


# ---- the tree -------------------------------------------------------------------------
def _log_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up where it is accurate to rounding."""
    y, below = x + 8, F.lit(1.0)
    for i in range(8):
        below = below * (x + i)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def _log_kt(zeros: Column, ones: Column) -> Column:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(key: Column) -> Column:
    """The decisions of a run's last symbol, as ``t`` (which one) and ``bit``."""
    symbol = key.bitwiseAND(F.lit(511).cast("long"))
    ended = F.array(F.struct(F.lit(0).cast("long").alias("t"), (symbol == END).cast("long").alias("bit")))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: F.struct(
            F.call_function("shiftright", symbol + 256, F.lit(8) - k).alias("t"),
            F.call_function("shiftright", symbol, F.lit(7) - k).bitwiseAND(F.lit(1).cast("long")).alias("bit"),
        ),
    )
    return F.when(symbol == END, ended).otherwise(F.concat(ended, bits))


def tree(runs: DataFrame, depth: int) -> list[DataFrame]:
    """``key, n`` of counted runs to ``node, n, p, ends`` by depth: the probability of a one at every node, and whether its path ends there.

    A node's number is its context's symbols times 256 plus the decision.
    """
    each = runs.select(F.shiftright("key", _SYMBOL).alias("context"), "n", F.inline(_decisions(F.col("key"))))
    level = each.groupBy((F.shiftleft("context", 8) + F.col("t")).alias("node")).agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("ones"),
    )
    kt = _log_kt(F.col("zeros"), F.col("ones"))
    kept = ("node", "zeros", "ones", "weighted")
    levels = {depth: written(level.withColumn("weighted", kt).select(*kept), f"tree-{depth}")}
    half = math.log(0.5)

    def parent(d: int) -> Column:
        """The node of the same decision one symbol less deep, at depth d."""
        context = F.shiftright("node", 8).bitwiseAND(F.lit((1 << _SYMBOL * d) - 1).cast("long"))
        return F.shiftleft(context, 8) + F.col("node").bitwiseAND(F.lit(255).cast("long"))

    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(parent(d).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        high, low = F.greatest("kt", "below"), F.least("kt", "below")
        up = up.withColumn("kt", kt).withColumn("weighted", half + high + F.log1p(F.exp(low - high)))
        levels[d] = written(up.select(*kept), f"tree-{d}")
    out, above = [], None
    for d in range(depth + 1):
        n, one = F.col("zeros") + F.col("ones"), (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
        # below a context seen once all estimates are its own: it is a leaf, at any depth
        own = F.lit(1.0) if d == depth else F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.exp(half + kt - F.col("weighted"))))
        now = levels[d].select("node", n.cast("long").alias("n"), one.alias("kt1"), own.alias("own"))
        if above is None:
            now = now.withColumns({"m": F.lit(0.0), "l": F.lit(1.0)})
        else:
            now = now.withColumn("parent", parent(d - 1)).join(above, "parent")
        mixed, left = F.col("m") + F.col("l") * F.col("own") * F.col("kt1"), F.col("l") * (1 - F.col("own"))
        p = F.when(left < 1 - 1e-9, mixed / (1 - left)).otherwise(F.col("kt1"))
        path = written(now.select("node", "n", mixed.alias("m"), left.alias("l"), p.alias("p")), f"tree-path-{d}")
        above = path.where("l > 0").select(F.col("node").alias("parent"), "m", "l")
        out.append(path.select("node", "n", "p", (F.col("l") <= 0).alias("ends")))
    return out


def run_values(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key, value``: the log10 probability of each run's last symbol, looked up in the written tree from the deepest context up.

    A run meets its context once a depth, with all nodes of that context (256 at most), and goes on with the decisions it has none for.
    """
    open_ = keys.select("key", F.shiftright("key", _SYMBOL).alias("context"), _decisions(F.col("key")).alias("open"), F.lit(0.0).alias("value"))
    done = []
    p = lambda x: F.try_element_at("held", x["t"])
    for d in range(len(levels) - 1, -1, -1):
        entry = F.struct(F.col("node").bitwiseAND(F.lit(255).cast("long")).alias("t"), "p")
        held = levels[d].groupBy(F.shiftright("node", 8).alias("at")).agg(F.map_from_entries(F.collect_list(entry)).alias("held"))
        at = F.col("context").bitwiseAND(F.lit((1 << _SYMBOL * d) - 1).cast("long"))
        told = open_.withColumn("at", at).join(F.broadcast(held) if d < 2 else held, "at", "left")  # up to depth 1 there are 257 contexts at most
        gained = F.aggregate("open", F.col("value"), lambda n, x: n + F.coalesce(F.log10(F.when(x["bit"] == 1, p(x)).otherwise(1 - p(x))), F.lit(0.0)))
        told = written(told.select("key", "context", F.filter("open", lambda x: p(x).isNull()).alias("open"), gained.alias("value")), f"tree-asked-{d}")
        done.append(told.where("size(open) = 0").select("key", "value"))
        open_ = told.where("size(open) > 0")
    # decisions that training never had to make
    done.append(open_.select("key", (F.col("value") + F.size("open") * math.log10(0.5)).alias("value")))
    return reduce(DataFrame.unionByName, done)


def _frequent(most: int, *counted: DataFrame) -> list[DataFrame]:
    """Of all tables together the rows with the largest ``n``: those from the least power of two on that leaves at most ``most``."""
    sizes: dict[int, int] = {}
    for df in counted:
        for r in df.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect():  # 64 rows at most
            sizes[r["e"]] = sizes.get(r["e"], 0) + r["count"]
    total, least = 0, 62
    for e in sorted(sizes, reverse=True):
        if total + sizes[e] > most:
            break
        total, least = total + sizes[e], e
    return [df.where(F.col("n") >= (1 << least)) for df in counted]


class _Lookup:
    """Values of 64-bit keys: an open-addressed table in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.key, self.value, self.used = size - 1, np.zeros(size, np.int64), np.zeros(size, values.dtype), np.zeros(size, bool)
        todo, at = np.arange(len(keys)), self._home(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = ~self.used[at]
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[at[put]], self.value[at[put]], self.used[at[put]] = keys[todo[put]], values[todo[put]], True
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def __getstate__(self) -> tuple[np.ndarray, np.ndarray]:
        return self.key[self.used], self.value[self.used]  # travels without its empty places

    def __setstate__(self, state: tuple[np.ndarray, np.ndarray]) -> None:
        self.__init__(*state)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) per key."""
        at = self._home(keys)
        found = self.used[at] & (self.key[at] == keys)
        value = self.value[at]
        todo = np.flatnonzero(~found & self.used[at])
        at = at[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & self.mask
            hit = self.used[at] & (self.key[at] == keys[todo])
            found[todo[hit]], value[todo[hit]] = True, self.value[at[hit]]
            more = ~hit & self.used[at]
            todo, at = todo[more], at[more]
        return found, value


class Model:
    """The most frequent nodes as arrays, with the code length of the most frequent runs worked out."""

    def __init__(self, depth: int, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], frequent: np.ndarray):
        # a value below zero: the path goes on below the node, maybe to a node that is not held
        self.depth, self.nodes = depth, [_Lookup(k, np.where(ends, p, -p)) for k, p, ends in nodes]
        value, sure = self._work_out(frequent)
        self.runs = _Lookup(frequent[sure], value[sure])

    def _work_out(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths, and which of them are sure: every decision's path ends at a node that is held."""
        symbol, context = codes & 511, codes >> _SYMBOL
        total, sure = np.zeros(len(codes)), np.ones(len(codes), bool)
        for k in range(-1, 8):
            t, bit = (np.zeros_like(symbol), symbol == END) if k < 0 else ((symbol + 256) >> (8 - k), (symbol >> (7 - k)) & 1 == 1)
            p, open_ = np.full(len(codes), 0.5), np.ones(len(codes), bool)
            if k >= 0:
                open_ &= symbol != END
            asked = open_.copy()
            for d in range(self.depth, -1, -1):
                rest = np.flatnonzero(open_)
                found, value = self.nodes[d].find(((context[rest] & ((1 << _SYMBOL * d) - 1)) << 8) + t[rest])
                hit = rest[found]
                p[hit] = np.abs(value[found])
                sure[hit[value[found] < 0]] = False
                open_[hit] = False
            sure &= ~open_
            total += np.where(asked, np.log10(np.where(bit, p, 1 - p)), 0.0)
        return total, sure

    def score(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure, value = self.runs.find(codes)
        if not sure.all():
            rest = ~sure
            rare, at = np.unique(codes[rest], return_inverse=True)
            worked, known = self._work_out(rare)
            value[rest], sure[rest] = worked[at], known[at]
        return value, sure


def _by_row(owner: np.ndarray, keys: np.ndarray, rows: int) -> pa.Array:
    """Distinct keys of every row with their number, as lists."""
    pairs, times = np.unique(np.stack([owner, keys]), axis=1, return_counts=True) if len(keys) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    edges = np.searchsorted(pairs[0], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[1]), pa.array(times.astype(np.int64))], names=["key", "times"]))


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    table = df.select(*columns).toArrow()
    return [table.column(c).to_numpy() for c in columns]


def score(docs: DataFrame, train: Column, depth: int = 4, nodes: int = 1 << 20, frequent: int = 1 << 19) -> DataFrame:
    """``doc_id, text`` to ``doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes``.

    ``train`` tells the rows to learn from; ``nodes`` and ``frequent`` bound the tables tasks hold, and change no result.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    counted = texts.where(train).select("text").mapInArrow(_count(depth), "kind int, key long, n long")
    counted = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "tree-counts")
    runs, words = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    per = total + 0.5 * (distinct + 1)

    whole = tree(runs, depth)
    levels = [tuple(_arrays(level, "node", "p", "ends")) for level in _frequent(nodes, *whole)]
    model = Model(depth, levels, _arrays(_frequent(frequent, runs)[0], "key")[0])
    known = written(_frequent(frequent, words)[0], "tree-words")
    common = _Lookup(*_arrays(known, "key", "n"))
    shared = spark.sparkContext.broadcast((model, common))
    rare = "array<struct<key:long,times:long>>"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = shared.value
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                raw, offsets = text_bytes(part.column("text"))
                codes, begin = _runs(raw, offsets, depth)
                value, sure = model.score(codes)
                scores = np.add.reduceat(np.where(sure, value, 0.0), begin[:-1])
                text = np.repeat(np.arange(part.num_rows), np.diff(begin))
                runs = _by_row(text[~sure], codes[~sure], part.num_rows)
                words, at = word_hashes(raw, offsets)
                words = np.insert(words.view(np.int64), at[1:], _WORD_END)
                at = at + np.arange(len(at))
                found, n = common.find(words)
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))
                gained = np.bincount(owner, weights=np.where(found, np.log10((n + 0.5) / per), 0.0), minlength=part.num_rows)
                hits = np.bincount(owner[found], minlength=part.num_rows)
                rest = _by_row(owner[~found], words[~found], part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(hits.astype(np.int64)), pa.array(gained), pa.array(scores), pa.array(np.diff(offsets)), rest, runs],
                    names=["doc_id", "n_tokens", "hits", "gained", "score", "n_bytes", "rest", "runs"],
                )

    scored = texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, hits long, gained double, score double, n_bytes long, rest {rare}, runs {rare}")
    scored = written(scored.withColumn("uid", F.monotonically_increasing_id()), "tree-scored")
    others = words.join(known.select("key"), "key", "left_anti")
    asked = scored.select("uid", F.inline("rest")).join(others, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = asked.groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_hits"), F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / per)).alias("more")
    )
    unsure = scored.select("uid", F.inline("runs"))
    values = written(run_values(unsure.select("key").distinct(), whole), "tree-values")
    deeper = unsure.join(values, "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("value")).alias("deeper"))
    return scored.drop("rest", "runs").join(more, "uid", "left").join(deeper, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("gained") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"), "n_bytes",
    )
