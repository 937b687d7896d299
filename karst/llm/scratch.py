"""Written tables in the shared folder that cut lineage between steps.

The folder is ``spark.checkpoint.dir``.  Only where that is unset, and Spark
runs in one local process, is a temporary folder used instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="karst-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/karst-{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Gives the list of tables that are written inside; those still in it are deleted at the end."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and returns what reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table written by ``stage`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("karst-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def as_text(column: str):
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
