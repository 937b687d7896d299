"""Points in time. Columns may be TIMESTAMP or TIMESTAMP_NTZ; the latter is read in the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col

#: Micros in each unit of a duration as text.
UNITS = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}
#: strftime marks and Spark's patterns.
FORMATS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%%": "%"}


def micros_of(duration: str) -> int:
    """The micros of a duration such as 1h30m."""
    import re

    parts = re.findall(r"(\d+)(us|ms|s|m|h|d|w)", duration)
    if not parts or "".join(a + b for a, b in parts) != duration:
        raise ValueError(f"not a duration: {duration!r}")
    return sum(int(n) * UNITS[u] for n, u in parts)


def _ts(x) -> Column:
    return col(x).cast("timestamp")


def now() -> Column:
    return F.current_timestamp()


def floor(ts, duration: str) -> Column:
    m, n = F.unix_micros(_ts(ts)), micros_of(duration)
    return F.timestamp_micros(m - F.pmod(m, F.lit(n)))


def round(ts, duration: str) -> Column:
    n = micros_of(duration)
    m = F.unix_micros(_ts(ts)) + n // 2
    return F.timestamp_micros(m - F.pmod(m, F.lit(n)))


def format(ts, pattern: str) -> Column:
    """By a strftime pattern."""
    import re

    spark = re.sub(r"%.|[A-Za-z]+|[^%A-Za-z]+", lambda m: FORMATS[m[0]] if m[0][0] == "%" else f"'{m[0]}'" if m[0][0].isalpha() else m[0], pattern)
    return F.date_format(_ts(ts), spark)


def group(ts, unit: str) -> Column:
    """Cut down to year, quarter, month, week, day, hour, minute or second."""
    return F.date_trunc(unit, _ts(ts))


def year(ts) -> Column:
    return F.year(_ts(ts))


def month(ts) -> Column:
    return F.month(_ts(ts))


def day(ts) -> Column:
    return F.dayofmonth(_ts(ts))


def hour(ts) -> Column:
    return F.hour(_ts(ts))


def minute(ts) -> Column:
    return F.minute(_ts(ts))


def second(ts) -> Column:
    return F.second(_ts(ts))


def week(ts) -> Column:
    return F.weekofyear(_ts(ts))


def weekday(ts) -> Column:
    """Monday is 1."""
    return F.weekday(_ts(ts)) + 1


def unix(ts) -> Column:
    return F.unix_seconds(_ts(ts))


def millis(ts) -> Column:
    return F.unix_millis(_ts(ts))


def micros(ts) -> Column:
    return F.unix_micros(_ts(ts))


def nanos(ts) -> Column:
    """NULL where they exceed a long, before 1677 and after 2262; ``micros`` holds any point."""
    return F.try_multiply(F.unix_micros(_ts(ts)), F.lit(1000))


def timezone() -> Column:
    return F.current_timezone()
