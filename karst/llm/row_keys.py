"""A key of its own for every row, also where ids are missing or come several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import as_text, stage

#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)


def keyed(rows: DataFrame, id: Column, key: str, text: str = "text") -> DataFrame:
    """rows with column ``key``: a long, unique, and in the order of the ids (null first), then of the texts' xxhash64.

    It is the id itself where no two rows share one.  Otherwise rows are sorted over all tasks
    and written with their places, so every reader finds the same keys.
    """
    held = rows.withColumn(key, F.coalesce(id, F.lit(NO_ID)))
    if held.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").isEmpty():
        return held
    # equal rows have any order; their places keep them from being one range
    order = held.withColumn("_hash", F.xxhash64(as_text(text))).withColumn("_place", F.monotonically_increasing_id()).orderBy(id.isNotNull(), key, "_hash", "_place")
    return stage(order.withColumn(key, F.monotonically_increasing_id()).drop("_hash", "_place"), "rows")
