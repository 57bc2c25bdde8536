"""Named queries over the sample tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import layout, wording


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return layout.QUERIES | wording.QUERIES


def oracle_sql() -> dict[str, str]:
    return layout.ORACLES | wording.ORACLES
