"""Arrow batches inside tasks: bounded slices, and text columns as bytes or strings; hashes that tell rows apart."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Text bytes worked on at once in a task; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def as_strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def identified(docs: DataFrame) -> DataFrame:
    """``(row, _row, _row2)``: each row in one struct, so that none of its columns' names can clash, and two hashes, never null, that
    together are one value for rows equal in all columns, and else differ."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64("*").alias("_row"), F.hash("*").alias("_row2"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` out of the struct ``row``, with ``new`` values for some."""
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
