"""Bounded-space online best-fit packing of token pieces into sequences of a fixed size.

A packer holds a fixed number of open bins. A bitset has a bit for each free
space that an open bin has; the lowest bit at or above a piece's length is the
best fit. Where nothing fits, a bin is opened, and beyond the fixed number the
fullest is closed. Pieces arrive in the order of their documents, and are placed as they arrive. They are dealt to
shards of a bounded expected size by a hash of their document, number and row, so the tasks stay small at every input
size and no key can be hot.

Empty and null texts have the one end token. Repeated rows are packed as often
as they occur.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import tokenizer
from .runtime import materialise, small_batches

#: Tokens of a sequence, open bins of a packer, and pieces of a shard as expected.
SIZE, OPEN, SHARD = 1024, 256, 65_536


def pieces(docs: DataFrame, path: str, ranks: str | None = None, end: int = 2, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its ids and the end token, cut only if longer than size, the first piece shorter."""
    small_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, ranks)
        for b in batches:
            rows: list[tuple] = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.encode(x) + last
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    m = min(n, size) if k else n % size or size
                    if n <= size:
                        m = n
                    rows.append((i, k, at, m, zlib.crc32(ids[4 * at : 4 * (at + m)])))
                    at, k = at + m, k + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.types[0]), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Best fit over a fixed number of open bins; place(length) gives the bin and the offset in it."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most, self.free, self.open, self.made = size, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        found = self.at[space].pop()
        if not self.at[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.size, self.made
            self.made += 1
        rest = space - length
        if rest:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            if not self.at[rest]:
                self.free |= 1 << rest
            self.at[rest].append(found)
            self.open += 1
        return found, self.size - space


def pack(parts: DataFrame, size: int = SIZE, most: int = OPEN, shard: int = SHARD, key: str = "doc_id") -> DataFrame:
    """parts with sequence_id and offset; parts need the key, piece and length, and keep their other columns.

    parts must be a written table, as the number of a row in it has a share in the shard.
    """
    n = max(1, -(-parts.count() // shard))
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "piece"], kind="stable", ignore_index=True).drop(columns="__shard")
        p = Packer(size, most)
        placed = [p.place(x) for x in rows["length"].tolist()]
        rows["sequence_id"] = [(k[0] << 40) + b for b, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows

    return parts.withColumn("__shard", F.pmod(F.xxhash64(key, "piece", F.monotonically_increasing_id()), F.lit(n)).cast("long")).groupBy("__shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, end: int = 2, size: int = SIZE, most: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pieces of all documents with their place in a sequence."""
    return pack(materialise(pieces(docs, path, ranks, end, size, key, text)), size, most, key=key)
