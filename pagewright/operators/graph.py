"""Connected components of a link table by alternating star contractions, wholly in DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import saved


def components(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, root) of every linked node but the roots themselves; links (*by, a, b) may repeat and run either way.

    Links join nodes with the same values of `by` only. The root is the least node of its component. Each
    half-round takes the least neighbour of each node by an aggregate that combines before the shuffle and joins it
    back, so a hub's links are never gathered in one row. Rounds go on until nothing changes; their number grows with
    the logarithm of the longest path.
    """
    by = list(by)

    def turned(x: DataFrame) -> DataFrame:
        return x.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first())

    now = saved(links.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    told = state(now)
    while True:
        # Large star: neighbours above a node go to its least neighbour.
        both = now.unionAll(turned(now))
        least = both.groupBy(*by, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, [*by, "a"]).where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its neighbours below it go to the least of these.
        least = large.groupBy(*by, "a").agg(F.min("b").alias("m"))
        down = large.join(least, [*by, "a"])
        now = saved(down.where("b <> m").select(*by, F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(*by, "a", F.col("m").alias("b"))).distinct())
        was, told = told, state(now)
        if told == was:
            return now.select(*by, F.col("a").alias("node"), F.col("b").alias("root"))
