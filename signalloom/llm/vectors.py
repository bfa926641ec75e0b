"""Vectors as rows of numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(name: str = "embedding") -> Column:
    return F.col(name).cast("array<double>")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries in a row, the n + 1 places where vectors begin, and which vectors are whole:
    not null, without null and non-finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return values, at, there & (bad[at[1:]] == bad[at[:-1]])

