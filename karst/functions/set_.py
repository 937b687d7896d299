"""Sets: arrays taken without regard to repeats; results are sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, val


def _set(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def add(xs, item) -> Column:
    return _set(F.array_append(col(xs), val(item)))


def difference(xs, ys) -> Column:
    """Items in exactly one of both."""
    a, b = col(xs), col(ys)
    return _set(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def intersect(xs, ys) -> Column:
    return _set(F.array_intersect(col(xs), col(ys)))


def is_empty(xs) -> Column:
    return F.size(col(xs)) == 0


def is_equal(xs, ys) -> Column:
    return _set(col(xs)) == _set(col(ys))


def length(xs) -> Column:
    return F.size(F.array_distinct(col(xs)))


def remove(xs, item) -> Column:
    return _set(F.array_remove(col(xs), val(item)))


def sort(xs) -> Column:
    return _set(col(xs))


def union(xs, ys) -> Column:
    return _set(F.array_union(col(xs), col(ys)))
