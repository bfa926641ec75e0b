"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash.  A bucket whose bytes
exceed the limit splits on its next bit, and only such buckets split, until every shard
fits.  The splits are not played one by one: one aggregation counts bytes in fine cells of
the hash, the bytes of every prefix are sums of cells, and a cell's bucket is its shortest
prefix that fits.  Cells that are still too large are counted again with more bits.

A shard is named by its hash prefix in bits ("" while nothing had to split).  Rows of the
same key have the same hash and stay together; if they alone exceed the limit, or one
document does, the shard cannot be split, keeps its 60 bits and is marked ``oversize``.
Null texts have no bytes, null keys hash like an empty name; texts of any length count with all their bytes.  An empty
table gives no rows.
Names the operator adds to ``docs`` (``shard``, ``shard_bytes``, ``oversize``) replace columns
of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.session import written

_BITS, _FINER, _MORE = 60, 4, 12


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, _BITS // 4), 16, 10).cast("long")


def _leading(h: str, bits: Column | int) -> Column:
    return F.call_function("shiftright", F.col(h), F.lit(_BITS) - (F.lit(bits) if isinstance(bits, int) else bits))


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Per counting round its bits and the cells: ``_cell, _depth, _prefix, _bytes`` (of the bucket).

    ``sizes`` has ``_h`` and ``_size`` per document.  One round is enough unless single
    documents or keys are larger than a shard; the loop ends as bits do.
    """
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    bits, done, rounds, rest = 0, -1, [], sizes
    while True:
        more = max(1, math.ceil(math.log2(max(2.0, total / limit)))) + _FINER if done < 0 else _MORE
        bits = min(_BITS, bits + more)
        cells = rest.groupBy(_leading("_h", bits).alias("_cell")).agg(F.sum("_size").alias("_size"))
        cells = written(cells, f"sharding-cells-{bits}")
        prefixes = (
            cells.select("_size", F.col("_cell"), F.explode(F.sequence(F.lit(done + 1), F.lit(bits))).alias("_depth"))
            .groupBy("_depth", F.call_function("shiftright", F.col("_cell"), F.lit(bits) - F.col("_depth")).alias("_prefix"))
            .agg(F.sum("_size").alias("_bytes"))
        )
        fits = prefixes.where((F.col("_bytes") <= limit) | (F.col("_depth") == _BITS))
        own = cells.select("_cell", F.explode(F.sequence(F.lit(done + 1), F.lit(bits))).alias("_depth")).withColumn(
            "_prefix", F.call_function("shiftright", F.col("_cell"), F.lit(bits) - F.col("_depth"))
        )
        settled = written(
            own.join(fits, ["_depth", "_prefix"]).groupBy("_cell").agg(F.min(F.struct("_depth", "_prefix", "_bytes")).alias("_b")).select("_cell", "_b.*"),
            f"sharding-directory-{bits}",
        )
        rounds.append((bits, settled))
        if bits == _BITS:
            return rounds
        open_cells = cells.join(settled, "_cell", "left_anti").select("_cell")
        if open_cells.isEmpty():
            return rounds
        rest = rest.withColumn("_cell", _leading("_h", bits)).join(open_cells, "_cell", "left_semi").drop("_cell")
        done = bits


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard``, ``shard_bytes`` and ``oversize``."""
    added = ("shard", "shard_bytes", "oversize")
    columns = [c for c in docs.columns if c not in added]
    h, size = hash_bits(F.col(key)), F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sizes = written(docs.select(h.alias("_h"), size.alias("_size")), "sharding-sizes")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), h.alias("_h"))
    buckets = None
    for bits, cells in directory(sizes, limit):
        found = cells.select("_cell", F.struct("_depth", "_prefix", "_bytes").alias("_found"))
        rows = rows.withColumn("_cell", _leading("_h", bits)).join(found, "_cell", "left").drop("_cell")
        rows = rows.withColumn("_bucket", F.col("_found") if buckets is None else F.coalesce("_bucket", "_found")).drop("_found")
        buckets = True
    name = F.when(F.col("_bucket._depth") == 0, "").otherwise(F.expr("lpad(bin(_bucket._prefix), _bucket._depth, '0')"))
    return rows.select(
        "_row.*", name.alias("shard"), F.col("_bucket._bytes").alias("shard_bytes"), (F.col("_bucket._bytes") > limit).alias("oversize")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; every shard is written by one task and fits the limit."""
    assigned.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
