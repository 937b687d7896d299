"""Expressions from text, with values bound and not pasted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(text: str) -> Column:
    """Spark SQL text as a column."""
    if not text or not text.strip():
        raise ValueError("an expression is needed")
    return F.expr(text)


def expr(text: str, **values) -> Column:
    """Spark SQL text in which :name stands for a value, passed as a literal."""
    import re

    def literal(m: re.Match) -> str:
        x = values[m[1]]
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, (int, float)):
            return repr(x)
        return "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"

    return raw(re.sub(r":(" + "|".join(map(re.escape, values)) + r")\b", literal, text) if values else text)


def as_(column: Column | str, name: str) -> Column:
    if not name or not name.strip():
        raise ValueError("an alias is needed")
    return (F.expr(column) if isinstance(column, str) else column).alias(name)


def col(name: str) -> Column:
    if not name or not name.strip():
        raise ValueError("a column name is needed")
    return F.col(name)


def negate(x) -> Column:
    return ~(F.col(x) if isinstance(x, str) else x)
