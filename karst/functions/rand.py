"""Random values; another one for each row and run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import val
from .crypto import uuid_v4, uuid_v7

__all__ = ["boolean", "enum", "floating", "guid", "integer", "rand", "string", "uuid_v4", "uuid_v7"]


def rand() -> Column:
    return F.rand()


def boolean() -> Column:
    return F.rand() < 0.5


def enum(*choices) -> Column:
    return F.element_at(F.array(*map(val, choices)), F.floor(F.rand() * len(choices)).cast("int") + 1)


def floating(low: float = 0.0, high: float = 1.0) -> Column:
    return low + F.rand() * (high - low)


def integer(low: int = -(2**31), high: int = 2**31 - 1) -> Column:
    """Both ends included."""
    return F.floor(low + F.rand() * (high - low + 1)).cast("bigint")


def string(length: int = 32) -> Column:
    return F.randstr(length)


def guid(length: int = 20) -> Column:
    return F.lower(F.randstr(length))
