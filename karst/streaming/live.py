"""Live queries: a stream over a change log of files.

The log has columns version, action, id and row (a struct). A live query is made
of stateless steps only, so it needs no watermark; ``diff`` keeps the last row of
each id as state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import predicates
from ..operators import graph

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = ("CREATE", "UPDATE", "DELETE")


def log_schema(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("version", T.LongType()), T.StructField("action", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row", row)])


class LastRow(StatefulProcessor):
    """Remembers each id's last row and tells what has changed, as a JSON patch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        old = json.loads(self.last.get()[0]) if self.last.exists() else None
        out = []
        # a trigger's changes of one id may come in several batches, in any order
        changes = [c for x in rows for c in zip(x["version"], x["action"], x["row"])]
        for version, action, row in sorted(changes, key=lambda c: c[0]):
            new = None if action == "DELETE" else json.loads(row)
            out.append((version, action, key[0], json.dumps(patch(old, new), sort_keys=True)))
            old = new
        if old is None:
            self.last.clear()
        else:
            self.last.update((json.dumps(old),))
        if out:
            yield pd.DataFrame(out, columns=["version", "action", "id", "patch"])

    def close(self) -> None:
        pass


def patch(old: dict | None, new: dict | None) -> list[dict]:
    """The operations that lead from one row to another."""
    if new is None:
        return [{"op": "remove", "path": "/"}] if old is not None else []
    if old is None:
        return [{"op": "replace", "path": "/", "value": new}]
    ops = [{"op": "remove", "path": f"/{k}"} for k in old if k not in new]
    ops += [{"op": "replace" if k in old else "add", "path": f"/{k}", "value": v} for k, v in new.items() if k not in old or old[k] != v]
    return sorted(ops, key=lambda o: o["path"])


@dataclass(frozen=True)
class Live:
    spark: SparkSession
    path: str
    row: T.StructType
    shown: tuple[str, ...] = ()
    conditions: tuple = ()
    one: str | None = None
    links: tuple = ()
    patches: bool = False

    def fields(self, *names: str) -> Live:
        return replace(self, shown=names)

    def value(self, name: str) -> Live:
        return replace(self, shown=(name,))

    def where(self, condition) -> Live:
        return replace(self, conditions=(*self.conditions, condition))

    def on_record(self, id: str) -> Live:
        """Only changes of one row."""
        return replace(self, one=id)

    def fetch(self, field: str, target: DataFrame) -> Live:
        """Links give way to rows of a table that does not stream."""
        return replace(self, links=(*self.links, (field, target)))

    def diff(self) -> Live:
        """Patches in place of rows."""
        return replace(self, patches=True)

    def stream(self) -> DataFrame:
        return self._over(self.spark.readStream.schema(log_schema(self.row)).parquet(self.path))

    def batch(self) -> DataFrame:
        """The same over what is in the log now; patches are for streams."""
        return replace(self, patches=False)._over(self.spark.read.schema(log_schema(self.row)).parquet(self.path))

    def _over(self, log: DataFrame) -> DataFrame:
        if self.one is not None:
            log = log.filter(F.col("id") == self.one)
        if self.patches:
            rows = log.select("id", "version", "action", F.to_json("row").alias("row"))
            return rows.groupBy("id").transformWithStateInPandas(LastRow(), "version long, action string, id string, patch string", "append", "none")
        df = log.select("version", "action", F.col("id").alias("_id"), "row.*")
        for condition in self.conditions:
            df = df.filter(predicates.resolve(df, condition))
        for field, target in self.links:
            df = graph.fetch(df, field, target)
        shown = self.shown or [f.name for f in self.row.fields]
        return df.select("version", "action", *shown)

    def start(self, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
        """Gives each batch of changes to a callback. Returns the query; its stop() ends the subscription."""
        writer = self.stream().writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        writer = writer.outputMode("append")
        writer = writer.trigger(availableNow=True) if once else writer
        if not self.patches:
            return writer.start()
        # state of this kind is kept by the RocksDB provider; a query keeps the settings that it starts with
        before = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKSDB)
        try:
            return writer.start()
        finally:
            if before is None:
                self.spark.conf.unset(PROVIDER)
            else:
                self.spark.conf.set(PROVIDER, before)
