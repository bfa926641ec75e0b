"""Pieces that several operators share."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# ---- rows that a join is about to find ----
_HINT_BITS, _MOST_BITS = 16, 1 << 27  # a key, and in all (16 MB)


class Hints(NamedTuple):
    """Which keys a table may hold: a bit per hash of a key, in rows of 4 kB."""

    rows: DataFrame
    size: int
    on: tuple[str, ...]


def hints_of(wanted: DataFrame, *on: str) -> Hints:
    """A bitmap of the hashed ``on`` of ``wanted``, a written table that has to stay while it is used; 16 bits a row, 16 MB at most."""
    size = min(_MOST_BITS, 1 << max(15, (_HINT_BITS * wanted.count() - 1).bit_length()))
    cell = _cell(size, on)
    rows = wanted.groupBy(F.bitmap_bucket_number(cell).alias("hint_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("hint_bits"))
    return Hints(rows, size, on)


def _cell(size: int, on: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit(size), *on).bitwiseAND(F.lit(size - 1).cast("long")) + 1


def hinted(rows: DataFrame, hints: Hints, there: bool = True) -> DataFrame:
    """Rows whose key may be in the hinted table, or with ``there=False`` all others, which are surely not.

    The bitmap goes to the rows, so rows that a join on the same key would not find are left out before they are shuffled.
    A key that is there is never missed; of the others one in 16 passes, more where the bitmap is full, so an exact join has to follow.
    """
    cell = _cell(hints.size, hints.on)
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("hint_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    found = (F.bitmap_bucket_number(cell) == F.col("hint_row")) & (F.getbit(byte, at.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1)
    return rows.join(F.broadcast(hints.rows), found, "left_semi" if there else "left_anti")


# ---- numpy over Arrow batches -------------------------------------------------
_rng = np.random.RandomState(20260101)  # fixed: hashes have to agree between tasks and runs
_BYTE_CODE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` bytes of text each (one row at least), so that work arrays stay small."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in a row and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER_CODE = _BYTE_CODE[_LOWER_BYTE]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power(back: bool, n: int) -> np.ndarray:
    """The first n powers of an odd number, or of its inverse modulo 2**64."""
    if len(_powers[back]) < n:
        p = np.full(max(n, 1 << 16), _BACK if back else _BASE, np.uint64)
        p[0] = 1
        _powers[back] = np.multiply.accumulate(p)
    return _powers[back][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased (A-Z) words in text order, and the n + 1
    places where each text's words begin; ``outside`` marks the bytes that part words.

    A word's hash sums its bytes' codes times powers of an odd number, so that it
    is a difference of running sums; equal words have equal hashes, and different
    words meet with probability about 2**-64.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~outside[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(_LOWER_CODE[raw], power(False, n), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * power(True, n)[starts]), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word runs of each text (the whole sequence where it is shorter), with the text each belongs to."""
    counts = np.diff(begins)
    multiply = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)]
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    if n >= k:
        hashed = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            hashed = mix(hashed + words[j : n - k + 1 + j] * multiply[j % 5] + np.uint64(j + 1))
        keep = doc[: n - k + 1] == doc[k - 1 :]
        hashed, owner = hashed[keep], doc[: n - k + 1][keep]
    else:
        hashed, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = []
        for d in short:
            h = np.array([counts[d]], np.uint64) * _ODD
            for w in range(begins[d], begins[d + 1]):
                h = mix(h + words[w : w + 1] * multiply[4])
            whole.append(h[0])
        hashed, owner = np.concatenate([hashed, np.array(whole, np.uint64)]), np.concatenate([owner, short])
    return hashed, owner
