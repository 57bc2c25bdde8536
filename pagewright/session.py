"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of our own, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagewright-")
        sc.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(large: DataFrame, small: DataFrame, on: str | list[str], how: str, rows: int = 500_000) -> DataFrame:
    """Join with a broadcast if small has at most so many rows, counted first, else with a shuffle."""
    n = small.limit(rows + 1).count()
    return large.join(F.broadcast(small) if n <= rows else small, on, how)


def clear(spark: SparkSession) -> int:
    """Remove all tables that this process has written between steps; results that still read them are lost."""
    jvm, n = spark.sparkContext._jvm, len(_written)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
