"""Conditions as Spark columns, with two-valued comparison: NULL equals no value and differs from every value.

A comparison with NULL is NULL, which a filter, AND and OR treat as false; ``negate`` and all
negative conditions turn it into false first.  So plain conditions reach the scan as they are.

A column may be given by name or as a column; values stay values unless they are columns.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def value(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _plain(test: Column) -> Column:
    """NULL becomes false, so that NOT has its plain meaning."""
    return F.coalesce(test, F.lit(False))


def eq(c, v) -> Column:
    return column(c).isNull() if v is None else column(c) == value(v)


def ne(c, v) -> Column:
    return column(c).isNotNull() if v is None else ~column(c).eqNullSafe(value(v))


def exactly(c, v) -> Column:
    """Equal, or both NULL."""
    return column(c).eqNullSafe(value(v))


def gt(c, v) -> Column:
    return column(c) > value(v)


def gte(c, v) -> Column:
    return column(c) >= value(v)


def lt(c, v) -> Column:
    return column(c) < value(v)


def lte(c, v) -> Column:
    return column(c) <= value(v)


def like(c, pattern: str) -> Column:
    return column(c).like(pattern)


def not_like(c, pattern: str) -> Column:
    return negate(like(c, pattern))


def starts_with(c, v: str) -> Column:
    return F.startswith(column(c), value(v))


def ends_with(c, v: str) -> Column:
    return F.endswith(column(c), value(v))


def is_null(c) -> Column:
    return column(c).isNull()


def is_not_null(c) -> Column:
    return column(c).isNotNull()


def contains(c, v) -> Column:
    """Part of a string."""
    return F.contains(column(c), value(v))


def has(c, v) -> Column:
    """Member of an array."""
    return F.lit(False) if v is None else F.array_contains(column(c), value(v))


def _array(values) -> Column:
    return values if isinstance(values, Column) else F.array(*map(F.lit, values))


def contains_any(c, values) -> Column:
    return F.arrays_overlap(column(c), _array(values))


def contains_all(c, values) -> Column:
    return F.size(F.array_except(_array(values), column(c))) == 0


def contains_none(c, values) -> Column:
    """NULL contains none."""
    return negate(contains_any(c, values))


def inside(c, values) -> Column:
    """One of some values, or within an array column."""
    if isinstance(values, DataFrame):
        return in_query(c, values)
    if isinstance(values, Column):
        return F.array_contains(values, column(c))
    values = [v for v in values if v is not None]
    return column(c).isin(*values) if values else F.lit(False)


in_ = inside


def not_inside(c, values) -> Column:
    return negate(inside(c, values))


def in_query(c, query: DataFrame) -> Column:
    """Among the values of a query of one column. Spark plans it as a semi join, its negation as an anti join."""
    if len(query.columns) != 1:
        raise ValueError("a subquery for IN has one column")
    # behind an alias only _in_query is to be seen, so the outer column can't be taken for one of the query's own
    inner = query.toDF("_in_query").alias("_in")
    return inner.filter(F.col("_in_query") == column(c).outer()).exists()


def intersects(point, ring) -> Column:
    """A point in or an array overlapping another."""
    from .functions import geo

    return geo.within(point, ring)


def outside(point, ring) -> Column:
    return negate(intersects(point, ring))


def matches(c, query: str, **analyser) -> Column:
    """Holds every term of a query, as the analyser cuts both (see search.tokens)."""
    from .operators import search

    terms = search.terms(query, **analyser)
    words = search.tokens(column(c), **analyser)
    return all_of(*(F.array_contains(words, t) for t in terms)) if terms else F.lit(False)


def raw(text: str) -> Column:
    """Spark SQL text, standing in brackets."""
    return F.expr(f"({text})")


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def negate(test: Column) -> Column:
    return ~_plain(test)


#: Operators by the way they are written.
OPERATORS = {
    "=": eq, "==": exactly, "!=": ne, ">": gt, ">=": gte, "<": lt, "<=": lte, "~": like, "!~": not_like,
    "CONTAINS": has, "CONTAINSANY": contains_any, "CONTAINSALL": contains_all, "CONTAINSNONE": contains_none,
    "INSIDE": inside, "IN": inside, "NOT INSIDE": not_inside, "OUTSIDE": outside, "INTERSECTS": intersects,
}


def build(c, operator: str, v) -> Column:
    if re.fullmatch(r"@\d*@", operator):  # the number names the match for its score and changes nothing here
        return matches(c, v)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    return OPERATORS[operator](c, v)


class Where:
    """Given to callbacks: w.eq("age", 3), w.any_of(...), with CONTAINS deciding by the column's type."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getattr__(self, name: str):
        found = globals().get(name)
        if name.startswith("_") or not callable(found):
            raise AttributeError(name)
        return found

    def contains(self, c: str, v) -> Column:
        kind = self.df.select(column(c)).schema[0].dataType
        return has(c, v) if isinstance(kind, T.ArrayType) else contains(c, v)


def resolve(df: DataFrame, condition) -> Column:
    """A condition given as a callback, a column or text."""
    if callable(condition) and not isinstance(condition, Column):
        condition = condition(Where(df))
    if isinstance(condition, str):
        return raw(condition)
    if not isinstance(condition, Column):
        raise TypeError("a condition is a callback, a column or text")
    return condition
