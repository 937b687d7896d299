"""Numbers. ``row_*`` functions work across columns of one row, ``agg_*`` down a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, row_array, val


def _one(f):
    def call(x) -> Column:
        return f(col(x))

    call.__name__, call.__doc__ = f.__name__, f"Spark's {f.__name__}."
    return call


abs, acos, asin, atan, ceil, cos = (_one(f) for f in (F.abs, F.acos, F.asin, F.atan, F.ceil, F.cos))
deg, exp, floor, log, log10, log2 = (_one(f) for f in (F.degrees, F.exp, F.floor, F.ln, F.log10, F.log2))
rad, sin, sqrt, tan = (_one(f) for f in (F.radians, F.sin, F.sqrt, F.tan))


def atan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def fixed(x, places: int) -> Column:
    return F.round(col(x), places)


def pow(x, y) -> Column:
    return F.pow(col(x), val(y))


def random() -> Column:
    return F.rand()


def round(x) -> Column:
    """Half away from zero."""
    return F.round(col(x))


def trunc(x) -> Column:
    """Towards zero."""
    return F.when(col(x) < 0, F.ceil(col(x))).otherwise(F.floor(col(x)))


def _doubles(xs) -> Column:
    return F.transform(row_array(*xs), lambda e: e.cast("double"))


def row_sum(*xs) -> Column:
    return F.aggregate(_doubles(xs), F.lit(0.0), lambda a, e: a + e)


def row_product(*xs) -> Column:
    return F.aggregate(_doubles(xs), F.lit(1.0), lambda a, e: a * e)


def row_min(*xs) -> Column:
    return F.array_min(row_array(*xs))


def row_max(*xs) -> Column:
    return F.array_max(row_array(*xs))


def row_mean(*xs) -> Column:
    return row_sum(*xs) / F.nullif(F.size(row_array(*xs)), F.lit(0))


def row_median(*xs) -> Column:
    ordered = F.array_sort(_doubles(xs))
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def row_variance(*xs) -> Column:
    """Sample variance; NULL below two values."""
    n = F.size(row_array(*xs))
    mean = row_mean(*xs)
    squares = F.aggregate(F.transform(_doubles(xs), lambda e: (e - mean) * (e - mean)), F.lit(0.0), lambda a, e: a + e)
    return squares / F.when(n > 1, n - 1)


def row_stddev(*xs) -> Column:
    return F.sqrt(row_variance(*xs))


agg_sum, agg_mean, agg_min, agg_max = (_one(f) for f in (F.sum, F.avg, F.min, F.max))
agg_median, agg_product, agg_stddev, agg_variance = (_one(f) for f in (F.median, F.product, F.stddev_samp, F.var_samp))
