"""Vectors of a table as NumPy matrices, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a matrix of doubles that a task works on at a time.
SLICE = 8 << 20


def sound(column: str) -> Column:
    """Whether a vector is there and all of its entries are finite numbers."""
    odd = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def width(vectors: DataFrame, column: str) -> tuple[int, int]:
    """The least and the greatest number of entries of the vectors (0, 0 where there is none)."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).head()
    return low or 0, high or 0


def padded(column: Column | str, dim: int, zero: Column) -> Column:
    """A vector with zeros behind it, up to ``dim`` entries."""
    c = F.col(column) if isinstance(column, str) else column
    return F.concat(c, F.array_repeat(zero, F.lit(dim) - F.size(c)))


def matrix(lists: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """Lists of ``dim`` numbers as the rows of a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), dim)


def slices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of about SLICE bytes as matrices."""
    rows = max(SLICE // (8 * max(dim, 1)), 1)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
