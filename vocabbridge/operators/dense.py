"""Arrow helpers for blocks of dense vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    if column.length() == 0:
        return np.zeros((0, dims))
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(column.length(), -1)


def as_column(matrix: np.ndarray) -> pa.ListArray:
    """A 2-D array as a list column."""
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def as_bytes(matrix: np.ndarray) -> pa.BinaryArray:
    """A 2-D array as one binary value per row."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(width * matrix.itemsize)
    data = pa.py_buffer(np.ascontiguousarray(matrix))
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), data])


def from_bytes(column: pa.ChunkedArray) -> np.ndarray:
    """Inverse of :func:`as_bytes`, for doubles."""
    values = column.combine_chunks()
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2])[ends[0] // 8 : ends[-1] // 8].reshape(len(values), -1)


def block_of(key: Column, blocks: int) -> Column:
    """Block number of a row key; hashing keeps the blocks about equal."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def blocks_for(df: DataFrame, block_rows: int) -> int:
    """Number of blocks of about ``block_rows`` rows."""
    return max(1, -(-df.count() // block_rows))


def pair_blocks(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, block_rows: int
):
    """Both sides cut into blocks and grouped so that every pair of blocks meets once.

    Returns a cogrouped pair keyed by (left block, right block).  Rows are copied once
    per block of the other side; rows of the two sides are never joined.
    """
    n_left, n_right = blocks_for(left, block_rows), blocks_for(right, block_rows)
    l_blocks = left.withColumn("_lb", block_of(F.col(left_key), n_left)).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    r_blocks = right.withColumn("_rb", block_of(F.col(right_key), n_right)).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )
    return l_blocks.groupBy("_lb", "_rb").cogroup(r_blocks.groupBy("_lb", "_rb"))
