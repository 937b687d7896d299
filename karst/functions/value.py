"""Values of one kind out of a VARIANT column; NULL for any other kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def _kept(pattern: str, kind: str | None):
    def call(v) -> Column:
        x = col(v)
        got = x if kind is None else F.try_variant_get(x, "$", kind)
        return F.when(F.schema_of_variant(x).rlike(pattern), got)

    call.__doc__ = f"Kept where the value's type matches {pattern}"
    return call


arrays, objects = _kept("^ARRAY", None), _kept("^OBJECT", None)
booleans, strings, ints = _kept("^BOOLEAN$", "boolean"), _kept("^STRING$", "string"), _kept("^BIGINT$", "bigint")
datetimes, decimals = _kept("^TIMESTAMP", "timestamp"), _kept("^DECIMAL", "decimal(38,18)")
floats, numbers = _kept("^(DOUBLE|FLOAT|DECIMAL)", "double"), _kept("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "double")


def durations(v) -> Column:
    """A VARIANT holds no durations; a typed interval column is kept as it is."""
    return col(v)


def points(v) -> Column:
    return F.try_variant_get(col(v), "$", "struct<lng:double,lat:double>")


def table(rid) -> Column:
    return F.substring_index(col(rid), ":", 1)


def thing(rid) -> Column:
    """Kept if it is a record id."""
    return F.when(col(rid).rlike(r"^\w+:\S+$"), col(rid))
