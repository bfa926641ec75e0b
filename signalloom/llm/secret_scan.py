"""Secret scans: patterns, and novelty under dictionary-primed zstandard.

Three base patterns give fixed spans.  A long mixed string that begins or ends within 48
characters of a sensitive word, on either side, is a candidate for more (of a string that only has such
words inside, the pieces between them): its marginal bytes are what a zstandard
frame of its surroundings grows by when it is put in, with the pieces of the corpus's most frequent identifiers
as dictionary.  What compresses like code or like known names is no secret; what costs close to
its entropy is reported as ``novel``.

Spans are code points, end exclusive.  Null and empty texts have none.  Texts are read
whole; the work on a long string grows with its length.  Other columns, whatever their names, are not read.  Rows are independent of each other, repeated rows give repeated results; only
the identifier dictionary is common, counted over all texts and cut to a number of names
that is a parameter.  An empty table gives no rows and an empty dictionary.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")  # a run of 16 or more: what the open pattern matches, less short runs
_NEAR = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "signature", "session")
_SENSITIVE = re.compile("|".join(_NEAR), re.IGNORECASE | re.ASCII)
_STRING = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_NAME = re.compile(r"[A-Za-z_]{4,}")
_REACH, _AROUND, _LEAST = 48, 160, 16


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def near_strings(text: str) -> list[tuple[int, int]]:
    """Long strings within reach of a sensitive word, none over another: a string that begins or ends within reach of a word
    outside it comes whole, one that only has such words inside as the pieces between them."""
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [s for s, _ in words], [e for _, e in words]
    out = []
    for m in _STRING.finditer(text):
        start, end = m.span()
        after = bisect_right(ends, start)  # words before the string; the last is the nearest
        before = bisect_left(starts, end)  # the first word after it
        if after and start - ends[after - 1] <= _REACH or before < len(words) and starts[before] - end <= _REACH:
            out.append((start, end))
            continue
        at = start
        for s, e in words[after:before]:  # words inside or across a border
            if s - at >= _LEAST:
                out.append((at, s))
            at = max(at, e)
        if before > after and end - at >= _LEAST:
            out.append((at, end))
    return out


class Novelty:
    """Marginal compressed bytes under a dictionary of identifiers."""

    def __init__(self, names: list[str], bits_a_char: float):
        raw = " ".join(reversed(names)).encode()  # the most frequent last: nearest to the text
        primed = {"dict_data": zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(raw) >= 8 else {}
        self.packer = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False, **primed)
        self.least = bits_a_char

    def marginal(self, text: str, start: int, end: int) -> int:
        left, right = text[max(0, start - _AROUND) : start], text[end : end + _AROUND]
        size = lambda t: len(self.packer.compress(t.encode("utf-8", "surrogatepass")))
        return size(left + right + " " + text[start:end]) - size(left + right + " ")

    def spans(self, text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        found = set()
        for start, end in near_strings(text):
            word = text[start:end]
            if not (re.search("[0-9]", word) and re.search("[A-Za-z]", word)):
                continue
            if any(s < end and start < e for s, _, e in base):
                continue
            if 8 * self.marginal(text, start, end) >= self.least * len(word):
                found.add((start, "novel", end))
        return sorted(found)


def identifiers(docs: DataFrame, most: int = 4096, documents: int = 8) -> list[str]:
    """The ``most`` pieces of identifiers that save most bytes: by count of documents times length, counted over all texts.

    Pieces are runs of letters and underscores, without digits, in at least so many ``documents``: a secret mixes
    digits and letters, so it is no piece, and one that leaks into a few documents does not become a known name.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["name", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(set(_NAME.findall(text)))
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= documents).orderBy((F.col("n") * F.length("name")).desc(), "name").limit(most)
    return [r["name"] for r in best.select("name").collect()]


def scan(docs: DataFrame, names: int = 4096, bits_a_char: float = 3.5) -> DataFrame:
    """``doc_id, text`` to ``doc_id`` and ``spans`` (array of start, kind, end), in order."""
    known = identifiers(docs, names)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known, bits_a_char)
        shape = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + novelty.spans(text or "", base), key=lambda s: (s[0], KINDS.index(s[1])))
                rows.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, shape)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,kind:string,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' digest and all spans as one string."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return scanned.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), of("novel").alias("n_novel"),
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
    )
