"""Facts about the session, as literals."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _conf(key: str):
    def call() -> Column:
        spark = SparkSession.active()
        return F.lit(spark.conf.get(f"karst.session.{key}", None)).cast("string")

    call.__doc__ = f"What the session was given as karst.session.{key}, or NULL."
    return call


expiry, origin, scope = _conf("expiry"), _conf("origin"), _conf("scope")
sc = scope


def id() -> Column:
    return F.lit(SparkSession.active().sparkContext.applicationId)


def token() -> Column:
    """Never shown."""
    return F.lit(None).cast("string")


def user() -> Column:
    return F.session_user()
