"""Full-text helpers; matching and scoring are plans, in operators.search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col


def highlight(s, before: str, after: str, *terms: str) -> Column:
    """Terms, in any case and as whole words, between two marks."""
    if not terms:
        return col(s)
    escape = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(s), "(?i)\\b(" + "|".join(map(re.escape, terms)) + ")\\b", f"{escape(before)}$1{escape(after)}")
