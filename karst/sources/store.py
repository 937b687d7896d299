"""Tables kept as Parquet under one folder: a change log for each, from which any version can be read.

Layout: ``<root>/<table>/log/version=<n>`` holds the change rows of version n and
``<root>/<table>/schema.json`` the row's type.  A version counts once its folder
has a ``_SUCCESS`` file, so a write that breaks off is not seen.

A writer claims the version after the one it has read by creating a file that must not be there
yet; of two writers that start from one version the second fails with ``Conflict``, and reads again.
``<root>/<table>/snapshot/version=<n>`` holds whole rows, written every ``SNAPSHOT`` versions, so a
read replays the changes after the last one only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files
from ..operators import mutate
from ..streaming.live import Live, log_schema


SNAPSHOT = 16


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: dict[str, int] = {}  # the version of each table that was read last

    def _log(self, table: str) -> str:
        return f"{self.root}/{table}/log"

    def define(self, table: str, schema: T.StructType) -> None:
        files.put(self.spark, f"{self.root}/{table}/schema.json", schema.json().encode())

    def schema(self, table: str) -> T.StructType:
        raw = files.get(self.spark, f"{self.root}/{table}/schema.json").select("content").first()
        return T.StructType.fromJson(json.loads(bytes(raw[0])))

    def remove(self, table: str) -> None:
        files.delete(self.spark, f"{self.root}/{table}")

    def _versions(self, folder: str) -> list[int]:
        fs, path = files._fs(self.spark, folder)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        jvm = self.spark.sparkContext._jvm
        done = [p for p in names if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def versions(self, table: str) -> list[int]:
        return self._versions(self._log(table))

    def _claim(self, table: str, version: int) -> None:
        fs, path = files._fs(self.spark, f"{self.root}/{table}/claims/{version}")
        try:
            fs.create(path, False).close()
        except Exception as e:
            if "already exists" in str(e) or fs.exists(path):
                raise Conflict(f"{table}: version {version} is taken; read again, or discard() what has broken off") from None
            raise

    def discard(self, table: str, version: int) -> None:
        """Frees a version that a writer has claimed and not completed."""
        if version in self.versions(table):
            raise ValueError(f"version {version} is complete")
        files.delete(self.spark, f"{self._log(table)}/version={version}")
        files.delete(self.spark, f"{self.root}/{table}/claims/{version}")

    def log(self, table: str, upto: int | None = None, after: int = 0) -> DataFrame:
        found = [v for v in self.versions(table) if after < v and (upto is None or v <= upto)]
        kind = log_schema(self.schema(table))
        if not found:
            return self.spark.createDataFrame([], kind)
        body = T.StructType([f for f in kind.fields if f.name != "version"])
        frames = self.spark.read.schema(body).option("basePath", self._log(table)).parquet(*(f"{self._log(table)}/version={v}" for v in found))
        return frames.select(F.col("version").cast("long").alias("version"), "action", "id", "row") if "version" in frames.columns else frames.withColumn("version", F.regexp_extract(F.input_file_name(), r"version=(\d+)", 1).cast("long")).select("version", "action", "id", "row")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table now or as it was; empty before its first version."""
        found = [v for v in self.versions(table) if version is None or v <= version]
        if version is None:
            self.seen[table] = (found or [0])[-1]
        if not found:
            return self.spark.createDataFrame([], self.schema(table))
        schema = self.schema(table)
        base = max((v for v in self._versions(f"{self.root}/{table}/snapshot") if v <= found[-1]), default=0)
        changes = self.log(table, found[-1], base)
        if base:
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}/snapshot/version={base}")
            kept = rows.select(F.lit(base).cast("long").alias("version"), F.lit("CREATE").alias("action"), "id", F.struct(*schema.fieldNames()).alias("row"))
            changes = kept.unionByName(changes)
        return mutate.replay(changes).select(*schema.fieldNames())

    def snapshot(self, table: str, version: int) -> None:
        """Writes the whole rows of a version."""
        self.read(table, version).write.mode("overwrite").parquet(f"{self.root}/{table}/snapshot/version={version}")

    def _base(self, table: str) -> int:
        """The version that a write starts from: the one read last."""
        return self.seen[table] if table in self.seen else (self.versions(table) or [0])[-1]

    def record(self, table: str, before: DataFrame, after: DataFrame) -> int:
        """Records a new version: ``before`` are the rows of the version read last that a write can touch, ``after`` what it makes of them."""
        version = self._base(table) + 1
        self._claim(table, version)
        try:
            rows = mutate.changes(before, after.select(*before.columns), version)
            rows.drop("version").write.mode("overwrite").parquet(f"{self._log(table)}/version={version}")
        except BaseException:
            self.discard(table, version)
            raise
        if version % SNAPSHOT == 0:
            self.snapshot(table, version)
        return version

    def write(self, table: str, after: DataFrame) -> int:
        """Records what leads from the version read last to ``after``, all rows of the table; returns the new version."""
        return self.record(table, self.read(table, self._base(table)), after)

    def show_changes(self, table: str, since: int = 0, limit: int = 10) -> DataFrame:
        return self.log(table).filter(F.col("version") >= since).orderBy("version", "id").limit(limit)

    def live(self, table: str) -> Live:
        return Live(self.spark, self._log(table), self.schema(table))
