"""Objects: columns of type MAP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def entries(m) -> Column:
    return F.map_entries(col(m))


def extend(m, other) -> Column:
    """Both together; where both have a key, other's value."""
    a, b = col(m), col(other)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def from_entries(pairs) -> Column:
    return F.map_from_entries(col(pairs))


def is_empty(m) -> Column:
    return F.size(col(m)) == 0


def keys(m) -> Column:
    return F.map_keys(col(m))


def length(m) -> Column:
    return F.size(col(m))


def remove(m, *names: str) -> Column:
    return F.map_filter(col(m), lambda k, v: ~k.isin(*names))


def values(m) -> Column:
    return F.map_values(col(m))
