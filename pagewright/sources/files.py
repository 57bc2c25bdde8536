"""Page images and archives as DataFrames, and archives written back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.session import saved

# File name endings of page images, compared in lower case.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tiff")


def images(files: DataFrame) -> DataFrame:
    """Rows of files (path, ...) whose name ends as an image's does."""
    return files.where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*SUFFIXES))


def numbered(rows: DataFrame, by: str, name: str = "pos") -> DataFrame:
    """rows with a number from 1 in the order of a column: ranges of it are ordered by a task each, and one task adds up their sizes."""
    rows = saved(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min(by).alias("first"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("first")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return rows.withColumn("own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("own") + F.col("before")).drop("__part", "own", "before")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Page images directly in a folder: page_id, pos by path, path, length, content. Files of no bytes are left out, as Spark's file sources do."""
    found = images(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path))
    names = numbered(found.select("path"), "path")
    return found.join(names, "path").select(F.regexp_extract("path", "([^/]+)$", 1).alias("page_id"), "pos", "path", "length", "content")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder has any file."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").load(path).select("path").limit(1).isEmpty()
    except AnalysisException:
        return False


def removed(spark: SparkSession, path: str) -> tuple[int, int]:
    """Remove a folder and all in it; the files found there before and left there after."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def count() -> int:
        return system.getContentSummary(where).getFileCount() if system.exists(where) else 0

    before = count()
    system.delete(where, True)
    return before, count()


def distinct_inputs(files: DataFrame) -> DataFrame:
    """The first row of each path, in the order given; files have pos and path."""
    return files.withColumn("__r", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where("__r = 1").drop("__r")


def clashes(files: DataFrame) -> DataFrame:
    """Output names that several inputs would write, with their number."""
    return files.groupBy(F.regexp_extract("path", "([^/]+)$", 1).alias("output_name")).agg(F.count("*").alias("n")).where("n > 1")


def members(archives: DataFrame) -> DataFrame:
    """(path, name, content, error): the files in each archive; an unreadable one, or a name that leads outside, gives an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for m in z.infolist():
                            parts = m.filename.replace("\\", "/").split("/")
                            if m.is_dir():
                                continue
                            if m.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                                rows.append((path, m.filename, None, "name leads outside"))
                            else:
                                rows.append((path, m.filename, z.read(m), None))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, "not an archive"))
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, (pa.string(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "name", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, "path string, name string, content binary, error string")


def archived(files: DataFrame, by: str = "folder") -> DataFrame:
    """(folder, content): one archive of the files (folder, name, content) of each folder, in name order.

    An archive is one value, so a folder must fit in a task's memory.
    """

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("name")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True):
                z.writestr(zipfile.ZipInfo(name), content or b"", zipfile.ZIP_DEFLATED)
        return pa.table({by: rows.column(by).slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return files.select(by, "name", "content").groupBy(by).applyInArrow(run, f"{by} string, content binary")
