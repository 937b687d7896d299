"""Writes as plans: old rows and a change in, new rows out. Nothing is changed in place.

``changes`` tells what a write did, as rows of a change log.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import predicates


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Appends; columns that new lacks are NULL."""
    return old.unionByName(new, allowMissingColumns=True).select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Appends the rows whose key is not there yet; of new rows with one key, one is taken."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return insert(old, fresh)


def records(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new stand in the place of those of equal key, as a whole, or are appended. new has distinct keys."""
    return insert(old.join(new.select(key), key, "left_anti").select(*old.columns), new)


def create(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Appends, and raises when a key is there already or comes twice."""
    taken = old.select(F.col(key).alias("_taken")).distinct()
    counts = new.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n"))
    checked = new.join(taken, new[key] == taken["_taken"], "left").join(counts, new[key] == counts["_again"], "left")
    bad = F.col("_taken").isNotNull() | (F.coalesce(F.col("_n"), F.lit(1)) > 1)
    raised = F.raise_error(F.concat(F.lit("id exists: "), F.col(key).cast("string"))).cast(old.schema[key].dataType)
    checked = checked.withColumn(key, F.when(bad, raised).otherwise(F.col(key)))
    return insert(old, checked.drop("_taken", "_again", "_n"))


def unique_violations(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that inserting new would have more than once; NULL is never a duplicate."""
    both = old.select(*keys).unionByName(new.select(*keys)).dropna(subset=keys)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _matches(old: DataFrame, where) -> Column:
    return F.lit(True) if where is None else predicates.resolve(old, where)


def _assigned(old: DataFrame, data: dict[str, Any], test: Column, readonly: tuple[str, ...]) -> DataFrame:
    if frozen := set(data) & set(readonly):
        raise ValueError(f"read-only: {sorted(frozen)}")
    if unknown := set(data) - set(old.columns):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    columns = [F.when(test, predicates.value(data[c])).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in data else F.col(c) for c in old.columns]
    return old.select(*columns)


def update(old: DataFrame, data: dict[str, Any], where=None, readonly: tuple[str, ...] = ()) -> DataFrame:
    """Sets columns of the matching rows; what is not named stays."""
    if not data:
        raise ValueError("nothing to set")
    return _assigned(old, data, _matches(old, where), readonly)


def replace(old: DataFrame, data: dict[str, Any], where, key: str = "id") -> DataFrame:
    """Sets columns of the matching rows; what is not named becomes NULL, but the key."""
    return _assigned(old, {c: data.get(c) for c in old.columns if c != key}, _matches(old, where), ())


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new update those of equal key, by the columns that new has, or are appended. new has distinct keys."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    there = F.col(f"b.{key}").isNotNull()
    columns = [F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns]
    return joined.select(*columns)


def upsert_where(old: DataFrame, where, data: dict[str, Any], new_id: Any, key: str = "id") -> DataFrame:
    """Updates the matching rows; if there are none, appends one."""
    if not data:
        raise ValueError("nothing to set")
    test = _matches(old, where)
    row = [(predicates.value(data[c]) if c in data else F.lit(new_id) if c == key else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    # one row of constants, there only if no row matches
    appended = old.agg(F.count_if(test).alias("_n")).filter("_n = 0").select(*row)
    return update(old, data, lambda w: test).unionByName(appended)


def delete(old: DataFrame, where=None, limit: int | None = None, key: str = "id") -> DataFrame:
    """What is left. With a limit, the matching rows of the smallest keys go."""
    test = F.coalesce(_matches(old, where), F.lit(False))
    if limit is None:
        return old.filter(~test)
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    gone = old.filter(test).select(key).orderBy(key).limit(limit)
    return old.join(gone, key, "left_anti").select(*old.columns)


def on_delete(referencing: DataFrame, link: str, gone: DataFrame, action: str, key: str = "id") -> DataFrame:
    """Rows with a link to deleted rows: cascade drops them, set_null clears the link, restrict raises."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    if action == "ignore":
        return referencing
    if action == "cascade":
        return referencing.join(ids, referencing[link] == ids["_gone"], "left_anti")
    marked = referencing.join(ids, referencing[link] == ids["_gone"], "left")
    if action == "set_null":
        return marked.withColumn(link, F.when(F.col("_gone").isNull(), F.col(link))).drop("_gone")
    if action == "restrict":
        raised = F.raise_error(F.concat(F.lit("still linked: "), F.col("_gone").cast("string"))).cast(referencing.schema[link].dataType)
        return marked.withColumn(link, F.when(F.col("_gone").isNull(), F.col(link)).otherwise(raised)).drop("_gone")
    raise ValueError(f"unknown action {action!r}")


def relate(edges: DataFrame, pairs: DataFrame, data: dict[str, Any] | None = None, table: str = "edge") -> DataFrame:
    """Appends an edge for each pair (in, out), with ids of their own; parallel edges are allowed."""
    new = pairs.select(F.concat(F.lit(f"{table}:"), F.expr("uuid()")).alias("id"), "in", "out", *(predicates.value(v).alias(k) for k, v in (data or {}).items()))
    return insert(edges, new)


def changes(before: DataFrame, after: DataFrame, version: int, key: str = "id") -> DataFrame:
    """(version, action, id, row): CREATE, UPDATE and DELETE rows that lead from before to after."""
    a = before.select(F.col(key).alias("_a"), F.struct(*before.columns).alias("old"))
    b = after.select(F.col(key).alias("_b"), F.struct(*before.columns).alias("new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    action = F.when(F.col("_a").isNull(), "CREATE").when(F.col("_b").isNull(), "DELETE").when(~F.to_json("old").eqNullSafe(F.to_json("new")), "UPDATE")
    out = both.select(F.lit(version).cast("long").alias("version"), action.alias("action"), F.coalesce("_b", "_a").alias("id"), F.coalesce("new", "old").alias("row"))
    return out.filter(F.col("action").isNotNull())


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The rows of a table as its change log leaves them, after all changes or those up to a version."""
    if upto is not None:
        log = log.filter(F.col("version") <= upto)
    last = log.groupBy("id").agg(F.max_by(F.struct("action", "row"), "version").alias("last"))
    return last.filter("last.action <> 'DELETE'").select("last.row.*")
