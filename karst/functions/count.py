"""Counting aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def count(x=None) -> Column:
    """Rows, or with an argument the rows where it is true (booleans) or not NULL (anything else)."""
    if x is None:
        return F.count(F.lit(1))
    # a false boolean casts to "false" in text: the one value left out
    return F.count(F.when(col(x).cast("string") != "false", F.lit(1)))


def count_all() -> Column:
    return F.count(F.lit(1))


def approx_count_distinct(x, error: float = 0.05) -> Column:
    return F.approx_count_distinct(col(x), error)


def count_distinct(x) -> Column:
    return F.count_distinct(col(x))
