"""Consecutive numbers for rows, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense(df: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """df with consecutive numbers from 0, in the given order or in that of the partitions.

    Rows are numbered within ranges; only one count for each range meets the others.
    """
    ranged = df.repartitionByRange(*order) if order else df
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    inside = Window.partitionBy("_part").orderBy(*(order or []), "_row")
    ranged = ranged.withColumn("_k", F.row_number().over(inside) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(counts.select("_part", "_before"), "_part").withColumn(column, F.col("_before") + F.col("_k")).drop("_part", "_row", "_k", "_before")
