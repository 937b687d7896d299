"""Files of any Hadoop file system. Reads are scans; the rest is done on the driver, never in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def get(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path or pattern."""
    return spark.read.format("binaryFile").load(path)


def list_(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length); contents are not read."""
    return get(spark, path).select("path", "modificationTime", "length")


info = list_


def put(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))
