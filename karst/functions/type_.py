"""Casts and tests of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col, val


def _cast(kind: str):
    def call(x) -> Column:
        return col(x).cast(kind)

    call.__doc__ = f"A cast to {kind}; bad text raises."
    return call


to_bool, to_datetime, to_decimal = _cast("boolean"), _cast("timestamp"), _cast("decimal(38,18)")
to_float = to_number = _cast("double")
to_int, to_string = _cast("bigint"), _cast("string")


def to_duration(x) -> Column:
    """From text such as 1h30m, of units w d h m s ms us."""
    text = col(x)

    def part(unit: str) -> Column:
        # the unit must not go on with a letter, so that m is not taken for ms
        return F.coalesce(F.regexp_extract(text, rf"(\d+){unit}(?![a-z])", 1).try_cast("bigint"), F.lit(0))

    seconds = part("s").cast("decimal(18,6)") + part("ms") / F.lit(1000).cast("decimal(18,6)") + part("us") / F.lit(1000000).cast("decimal(18,6)")
    return F.when(
        text.rlike(r"^(\d+(w|d|h|m|s|ms|us))+$"),
        F.make_dt_interval((part("w") * 7 + part("d")).cast("int"), part("h").cast("int"), part("m").cast("int"), seconds.cast("decimal(18,6)")),
    )


def point(lng, lat) -> Column:
    return F.struct(col(lng).cast("double").alias("lng"), col(lat).cast("double").alias("lat"))


def thing(table, key) -> Column:
    """A record id."""
    return F.concat(val(table), F.lit(":"), col(key).cast("string"))


record = thing


def field(name: str) -> Column:
    return F.col(name)


def _is(pattern: str):
    def call(x) -> Column:
        return F.typeof(col(x)).rlike(pattern)

    call.__doc__ = f"True where the column's type matches {pattern}"
    return call


is_array, is_bool, is_datetime = _is("^array"), _is("^boolean$"), _is("^timestamp")
is_decimal, is_duration, is_float = _is("^decimal"), _is("^interval"), _is("^(float|double)$")
is_int = _is("^(tinyint|smallint|int|bigint)$")
is_number = _is("^(tinyint|smallint|int|bigint|float|double|decimal)")
is_object, is_point, is_string = _is("^(map|struct)"), _is("^struct<lng:double,lat:double>$"), _is("^string")


def is_record(x) -> Column:
    return F.coalesce(col(x).rlike(r"^\w+:\S+$"), F.lit(False))
