"""Page files as a stream: new files of a folder, counted by window of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.files import images

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the page images that come into a folder."""
    return images(spark.readStream.format("binaryFile").schema(SCHEMA).load(path))


def counted(files: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and bytes in each window of time; files later than the watermark are left out of closed windows."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
