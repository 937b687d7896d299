"""Shared small helpers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Any) -> Column:
    """A column as it is, a string as a column's name, anything else as a value."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def val(x: Any) -> Column:
    """A column as it is, anything else as a value."""
    return x if isinstance(x, Column) else F.lit(x)


def row_array(*xs: Any) -> Column:
    """Several columns, or one array column, as an array."""
    return col(xs[0]) if len(xs) == 1 else F.array(*map(col, xs))
