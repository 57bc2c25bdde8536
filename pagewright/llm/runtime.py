"""Shared plumbing of the subpackage: lineage cuts, checked broadcasts, Arrow batches as numpy buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import join_small
from pagewright.session import saved as materialise

__all__ = ["buffers", "join_hot", "join_small", "materialise", "slices", "small_batches"]

#: Rows of an Arrow batch handed to Python; texts are long, so the default of 10,000 is too many.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of text columns small; a lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def join_hot(large: DataFrame, small: DataFrame, on: str, part: int = 100_000) -> DataFrame:
    """Left join on a column of which some values may hold a large part of large; small has it once, with its rows there in n.

    Values with more than a part-th of the rows, so as many at most, are broadcast; the others are shuffled.
    """
    bound = large.count() // part
    hot = F.broadcast(small.where(F.col("n") > bound))
    found = large.join(hot, on)
    rest = large.join(hot.select(on), on, "left_anti").join(small.where(F.col("n") <= bound), on, "left")
    return found.unionByName(rest)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n + 1 offsets from 0; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
