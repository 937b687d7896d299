"""Record ids, table:key; the key may itself hold a colon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def id(rid) -> Column:
    """The key."""
    return F.regexp_extract(col(rid), "(?s)^[^:]*:(.*)$", 1)


def table(rid) -> Column:
    return F.substring_index(col(rid), ":", 1)
