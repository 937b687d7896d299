"""Columns of type BINARY; bitwise operations are built from their hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def length(b) -> Column:
    return F.octet_length(col(b))


def resize(b, n: int) -> Column:
    """Cut, or filled with zero bytes, to n bytes."""
    return F.substring(F.rpad(col(b), n, F.lit(b"\0")), 1, n)


def _pairs(b: Column) -> Column:
    """The two hexadecimal digits of each byte."""
    return F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))


def reverse(b) -> Column:
    return F.unhex(F.array_join(F.reverse(_pairs(col(b))), ""))


def to_string(b) -> Column:
    """As UTF-8; malformed bytes raise."""
    return F.decode(col(b), "UTF-8")


def _bitwise(name: str):
    def call(a, b) -> Column:
        """Byte by byte; a longer side is cut to the shorter."""
        x, y = _pairs(col(a)), _pairs(col(b))
        n = F.least(F.size(x), F.size(y))
        number = lambda h: F.conv(h, 16, 10).cast("int")
        each = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: F.lpad(F.hex(getattr(number(p), name)(number(q))), 2, "0"))
        return F.unhex(F.array_join(each, ""))

    return call


xor, and_, or_ = _bitwise("bitwiseXOR"), _bitwise("bitwiseAND"), _bitwise("bitwiseOR")
