"""Base64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def base64_encode(b) -> Column:
    """On one line."""
    return F.regexp_replace(F.base64(col(b).cast("binary")), "[\\r\\n]", "")


def base64_decode(s) -> Column:
    return F.unbase64(col(s))
