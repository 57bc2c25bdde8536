"""Kernels that see one page at a time, streamed through Arrow: pages of a partition follow each other, sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import saved


def attempted(pages: DataFrame, work: Callable[[dict], bytes], tries: int = 1) -> DataFrame:
    """(page, result, error): what work makes of each page's row, or why it failed; one page's failure leaves the others alone."""
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                result, error = None, "not tried"
                for _ in range(tries):
                    try:
                        result, error = work({c: row[c] for c in names}), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([row["page"]], pa.int64()), pa.array([result], pa.binary()), pa.array([error], pa.string())], ["page", "result", "error"])

    return saved(pages.withColumn("page", F.col("page").cast("long")).mapInArrow(run, "page long, result binary, error string"))


def run_summary(results: DataFrame) -> DataFrame:
    """One row: pages in all, done, failed, and an error message if none was done."""
    failed = F.count_if(F.col("error").isNotNull())
    return results.agg(F.count("*").alias("total"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"), F.when((F.count("*") == failed) & (failed > 0), F.min("error")).alias("error_message"))


def by_page(rows: DataFrame, columns: list[str], kernel: Callable[[list[tuple]], list[tuple]], names: list[str]) -> DataFrame:
    """(page, pos, *names), all long: what a kernel makes of the whole-number columns of each page, in the order of `pos`.

    A page's rows are held by one task, so a kernel is for pages, which have few; many pages are spread over tasks.
    """
    told = ["page", "pos", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(held, axis=1)
            page = whole[0]
            starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
            ends = np.append(starts[1:], len(page))
            done = len(starts) if last else len(starts) - 1
            out: list[tuple] = []
            for s, e in zip(starts[:done].tolist(), ends[:done].tolist(), strict=True):
                own = int(page[s])
                out += [(own, k, *x) for k, x in enumerate(kernel(list(zip(*(c.tolist() for c in whole[1:, s:e]), strict=True))))]
            held.clear()
            if not last:
                held.append(whole[:, starts[-1] :])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], told)

        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
                yield from flush(False)
        if held:
            yield from flush(True)

    # A kernel's work is more than its few bytes tell: with a stated number, tasks are not put together by their bytes.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(*(F.col(c).cast("long").alias(c) for c in ("page", *columns)), "pos").repartition(tasks, "page").sortWithinPartitions("page", "pos").drop("pos")
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in told))
