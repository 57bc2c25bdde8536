"""Files written by a DataFrame: each row a file of a folder that all executors share."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "page_files"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote."""

    files: int
    bytes: int


class FolderWriter(DataSourceArrowWriter):
    """Writes (name, content) rows under a folder. A file appears whole or not at all, by a move; a task that runs again writes the same files again."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder) if re.match(r"\w+://|file:", self.folder) else (fs.LocalFileSystem(), self.folder)
        files = size = 0
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                target = posixpath.join(root, name)
                system.create_dir(posixpath.dirname(target), recursive=True)
                # The name is of this attempt alone, so two attempts never write one file.
                staged = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}")
                data = content.as_buffer()
                with system.open_output_stream(staged) as out:
                    out.write(data)
                system.move(staged, target)
                files, size = files + 1, size + data.size
        return Written(files, size)


class Folder(DataSource):
    """A sink of files: options path; a file of the same name is replaced, others stay."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("the folder is not emptied: remove it first, then append")
        return FolderWriter(self.options["path"])


def inside(name: Column) -> Column:
    """Whether a name stays within the folder: relative, with no step up, and not empty."""
    return F.coalesce(~name.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^\w:|[/\\]$|^$"), F.lit(False))


def written(files: DataFrame, path: str) -> int:
    """Write files (name, content) under a folder; their number.

    Names that lead outside, are null or come twice, and null contents, are an error before anything is written; empty contents give empty
    files. An empty table writes nothing. The rows are computed once for the test and once to be written, so they must be deterministic.
    """
    spark: SparkSession = files.sparkSession
    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    named = rows.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.col("content").isNull()).alias("empty"))
    n, outside, twice, empty = named.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~inside(F.col("name"))), F.count_if(F.col("n") > 1), F.count_if(F.col("empty"))).first()
    if outside or twice or empty:
        raise ValueError(f"{outside} names lead outside or are missing, {twice} come twice, {empty} have no content")
    spark.dataSource.register(Folder)
    rows.write.format(FORMAT).mode("append").option("path", path).save()
    return n
