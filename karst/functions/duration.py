"""Durations: columns of type INTERVAL DAY TO SECOND; whole units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def _per(interval: str):
    def call(d) -> Column:
        x = col(d)
        # interval / interval is not defined, so both become micros
        return F.floor(F.call_function("div", x, F.expr(interval))).cast("long")

    return call


micros = _per("INTERVAL '0.000001' SECOND")
millis = _per("INTERVAL '0.001' SECOND")
secs = _per("INTERVAL '1' SECOND")
mins = _per("INTERVAL '1' MINUTE")
hours = _per("INTERVAL '1' HOUR")
days = _per("INTERVAL '1' DAY")
weeks = _per("INTERVAL '7' DAY")


def nanos(d) -> Column:
    """NULL where they exceed a long, beyond some 292 years; ``micros`` holds any duration."""
    return F.try_multiply(micros(d), F.lit(1000))


def maximum() -> Column:
    """The largest duration."""
    return F.expr("INTERVAL '106751991 04:00:54.775807' DAY TO SECOND")
