"""Vectors: columns of type ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, val


def _v(x) -> Column:
    return col(x).cast("array<double>")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, e: a + e)


def add(a, b) -> Column:
    return F.zip_with(_v(a), _v(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_v(a), _v(b), lambda x, y: x - y)


def multiply(a, factor) -> Column:
    return F.transform(_v(a), lambda x: x * val(factor))


def dot(a, b) -> Column:
    return _total(F.zip_with(_v(a), _v(b), lambda x, y: x * y))


def magnitude(a) -> Column:
    return F.sqrt(_total(F.transform(_v(a), lambda x: x * x)))


def normalize(a) -> Column:
    """NULL for a vector of length 0."""
    n = F.nullif(magnitude(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(_v(a), lambda x: x / n))


def similarity(a, b) -> Column:
    """Cosine; NULL where a vector has length 0."""
    return dot(a, b) / F.nullif(magnitude(a) * magnitude(b), F.lit(0.0))


def angle(a, b) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity(a, b))))


def cross(a, b) -> Column:
    """Of two vectors of three."""
    x, y = _v(a), _v(b)
    return F.array(*(x[i] * y[j] - x[j] * y[i] for i, j in ((1, 2), (2, 0), (0, 1))))


def distance(a, b) -> Column:
    """Euclidean."""
    return F.sqrt(_total(F.zip_with(_v(a), _v(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a, b) -> Column:
    return _total(F.zip_with(_v(a), _v(b), lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float = 3) -> Column:
    return F.pow(_total(F.zip_with(_v(a), _v(b), lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))
