"""Named sequences: counters kept by the engine; values for rows are dealt without a single task.

A sequence is state on the driver.  ``number`` reserves as many values as a
DataFrame has rows and gives them out by a count of rows per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Sequence:
    name: str
    start: int = 1
    step: int = 1
    low: int | None = None
    high: int | None = None
    cycle: bool = False
    value: int | None = None

    def next(self) -> int:
        new = self.start if self.value is None else self.value + self.step
        low = self.low if self.low is not None else -(1 << 63)
        high = self.high if self.high is not None else (1 << 63) - 1
        if not low <= new <= high:
            if not self.cycle:
                raise OverflowError(f"sequence {self.name} is used up")
            new = low if self.step > 0 else high
        self.value = new
        return new

    def peek(self) -> int | None:
        return self.value

    def set(self, value: int) -> None:
        self.value = value


def number(df: DataFrame, sequence: Sequence, column: str) -> DataFrame:
    """df with one more column of consecutive values; which row gets which is not defined."""
    from ..operators.numbering import dense

    numbered = dense(df, column)
    first = sequence.next()
    total = numbered.agg(F.max(column)).first()[0]
    if total:
        sequence.set(first + total * sequence.step)
    return numbered.withColumn(column, F.lit(first) + F.col(column) * sequence.step)
