"""Set operations; each takes the result so far and one more operand, so a chain goes from left to right."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b."""
    return a.subtract(b.select(*a.columns))


OPERATIONS = {"union": union, "union_all": union_all, "intersect": intersect, "except": except_}
