"""One entry point: tables by name, queries, writes, transactions and statements."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import predicates
from .functions.sequence import Sequence
from .operators import mutate
from .plans.select import Select
from .schema import Table
from .sources import shared
from .sources.store import Store


def _named(new: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Of a table's rows those that have an id of new."""
    return lambda rows: rows.join(new.select("id"), "id", "left_semi").select(*rows.columns)


@dataclass(frozen=True)
class Model:
    """A table's verbs without its name; ids may leave the name out too."""

    db: Database
    name: str

    def _id(self, id: str) -> str:
        return id if id.startswith(f"{self.name}:") else f"{self.name}:{id}"

    def select(self, id: str | None = None) -> Select:
        return self.db.select(self.name if id is None else self._id(id))

    def find(self, id: str) -> dict | None:
        row = self.select(id).df().first()
        return row.asDict(recursive=True) if row else None

    def insert(self, rows: list[dict] | DataFrame, ignore_duplicates: bool = False) -> None:
        self.db.insert(self.name, rows, ignore_duplicates)

    def records(self, rows: list[dict] | DataFrame) -> None:
        self.db.records(self.name, rows)

    def create(self, data: dict, id: str | None = None) -> None:
        self.db.create(self.name, data, id)

    def update(self, data: dict, id: str | None = None, where=None) -> None:
        self.db.update(self.name if id is None else self._id(id), data, where)

    def replace(self, id: str, data: dict) -> None:
        self.db.replace(self._id(id), data)

    def upsert(self, rows: list[dict] | DataFrame) -> None:
        self.db.upsert(self.name, rows)

    def delete(self, id: str | None = None, where=None, limit: int | None = None) -> None:
        self.db.delete(self.name if id is None else self._id(id), where, limit)


@dataclass
class Event:
    """A trigger: when a change of the table fulfils a condition, a handler gets the change rows."""

    name: str
    table: str
    when: str
    then: Callable[[DataFrame], None]


class Database:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.store = Store(spark, root) if root else None
        self.tables: dict[str, Table] = {}
        self.frames: dict[str, DataFrame] = {}
        self.variables: dict[str, Any] = {}
        self.sequences: dict[str, Sequence] = {}
        self.events: list[Event] = []
        self.staged: dict[str, DataFrame] | None = None

    # -- definitions
    def define(self, table: Table, df: DataFrame | None = None) -> Table:
        """Declares a table; rows come from df, or from the store."""
        self.tables[table.name] = table
        if df is not None:
            self.frames[table.name] = df
        elif self.store:
            self.store.define(table.name, table.struct())
        else:
            self.frames[table.name] = self.spark.createDataFrame([], table.struct())
        return table

    def remove(self, name: str) -> None:
        self.tables.pop(name, None)
        if self.frames.pop(name, None) is None and self.store:
            self.store.remove(name)

    def define_function(self, name: str, args: dict[str, str], returns: str, body: str) -> None:
        """A function with an SQL body, to use in any expression."""
        given = ", ".join(f"{k} {v}" for k, v in args.items())
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {returns} RETURN {body}")

    def define_param(self, name: str, value: Any) -> None:
        self.variables[name] = value

    let = define_param

    def define_sequence(self, name: str, **options) -> Sequence:
        self.sequences[name] = Sequence(name, **options)
        return self.sequences[name]

    def define_event(self, name: str, table: str, when: str, then: Callable[[DataFrame], None]) -> None:
        self.events.append(Event(name, table, when, then))

    # -- reading
    def table(self, name: str) -> Table | None:
        return self.tables.get(name)

    def _all(self, name: str) -> DataFrame:
        """All rows of a table, also those that its permission to select hides."""
        if self.staged and name in self.staged:
            return self.staged[name]
        if name in self.frames:
            return self.frames[name]
        if self.store and name in self.tables:
            return self.store.read(name)
        return self.spark.table(name)

    def frame(self, name: str) -> DataFrame:
        df = self._all(name)
        table = self.tables.get(name)
        return table.visible(df) if table else df

    def as_of(self, name: str, version: int) -> DataFrame:
        if not self.store:
            raise ValueError("versions need a store")
        return self.store.read(name, version)

    def model(self, table: str | Table) -> Model:
        """The verbs of one table, bound to it."""
        return Model(self, table.name if isinstance(table, Table) else table)

    bind_table = model

    def select(self, target: str | Table) -> Select:
        """From a table, or with a record id from its one row."""
        name = target.name if isinstance(target, Table) else target
        if ":" in name:
            return Select(self, name.partition(":")[0]).where(F.col("id") == name)
        return Select(self, name)

    def query(self, text: str, **values) -> DataFrame:
        """Spark SQL; :name stands for a value, given here or defined before."""
        return self.spark.sql(text, args={k: v for k, v in {**self.variables, **values}.items() if f":{k}" in text})

    # -- writing
    def _write(self, name: str, after: DataFrame) -> None:
        if self.staged is not None:
            self.staged[name] = after
            return
        self._commit({name: after})

    def _apply(self, name: str, part: Callable[[DataFrame], DataFrame], verb: Callable[[DataFrame], DataFrame]) -> None:
        """Writes what the verb makes of all rows.  Where they are stored, only the part that it can touch is compared."""
        rows = self._all(name)
        if self.staged is not None or name in self.frames or not self.store:
            self._write(name, verb(rows))
            return
        before = part(rows)
        self._fire(name, self._recorded(name, self.store.record(name, before, verb(before))))

    def _recorded(self, name: str, version: int) -> DataFrame:
        return self.store.log(name, version, version - 1)

    def _commit(self, tables: dict[str, DataFrame]) -> None:
        for name, after in tables.items():
            before = self.frames.get(name)
            if before is None and self.store:
                log = self._recorded(name, self.store.write(name, after))
            else:
                self.frames[name] = after
                log = mutate.changes(before, after, 0) if any(e.table == name for e in self.events) else None
            self._fire(name, log)

    def _fire(self, name: str, log: DataFrame | None) -> None:
        for event in self.events:
            if event.table == name:
                found = log.filter(F.expr(event.when))
                if not found.isEmpty():
                    event.then(found)

    def _where(self, name: str, where) -> Column:
        """A condition on the rows of a table, TRUE only for those that its permission to select lets through."""
        test = F.lit(True) if where is None else predicates.resolve(self._all(name), where)
        table = self.tables.get(name)
        if table and "select" in table.permissions:
            test = test & F.expr(table.permissions["select"])
        return F.coalesce(test, F.lit(False))

    def _rows(self, name: str, rows: list[dict] | DataFrame) -> DataFrame:
        table = self.tables.get(name)
        if isinstance(rows, DataFrame):
            df = rows
        else:
            if not rows or not all(rows):
                raise ValueError("no data")
            columns = list(dict.fromkeys(k for r in rows for k in r))
            kinds = {f.name: f.dataType for f in (table.struct() if table else self.frame(name).schema).fields}
            from pyspark.sql import types as T

            schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])
            df = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
        if "id" not in df.columns:
            df = df.withColumn("id", F.concat(F.lit(f"{name}:"), F.expr("uuid()")))
        if table:
            df = table.conform(table.visible(df, "create"))
            for keys in table.unique_keys():
                clash = mutate.unique_violations(self._all(name), df, list(keys)).first()
                if clash:
                    raise ValueError(f"{name}: {keys} is unique; there twice: {tuple(clash)[:-1]}")
        return df

    def insert(self, name: str, rows: list[dict] | DataFrame, ignore_duplicates: bool = False) -> None:
        new = self._rows(name, rows)
        self._apply(name, _named(new), lambda old: mutate.insert_ignore(old, new) if ignore_duplicates else mutate.insert(old, new))

    def records(self, name: str, rows: list[dict] | DataFrame) -> None:
        """Rows that stand in the place of those of equal id, as a whole."""
        new = self._rows(name, rows)
        self._apply(name, _named(new), lambda old: mutate.records(old, new))

    def create(self, name: str, data: dict, id: str | None = None) -> None:
        if not data:
            raise ValueError("no data")
        given = {**data, **({"id": id if ":" in id else f"{name}:{id}"} if id else {})}
        new = self._rows(name, [given])
        self._apply(name, _named(new), lambda old: mutate.create(old, new))

    def _readonly(self, name: str) -> tuple[str, ...]:
        table = self.tables.get(name)
        return tuple(n for n, f in table.fields.items() if f.readonly) if table else ()

    def update(self, target: str, data: dict, where=None) -> None:
        """Merges data into one row (table:key), the matching rows or all."""
        name, colon, _ = target.partition(":")
        test = self._where(name, (lambda w: w.eq("id", target)) if colon else where)
        self._apply(name, lambda old: old.filter(test), lambda old: mutate.update(old, data, lambda w: test, self._readonly(name)))

    def replace(self, target: str, data: dict) -> None:
        name = target.partition(":")[0]
        test = self._where(name, lambda w: w.eq("id", target))
        self._apply(name, lambda old: old.filter(test), lambda old: mutate.replace(old, data, lambda w: test))

    def upsert(self, name: str, rows: list[dict] | DataFrame) -> None:
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self._given(name, rows))
        self._apply(name, _named(new), lambda old: mutate.upsert(old, new))

    def _given(self, name: str, rows: list[dict]):
        from pyspark.sql import types as T

        return T.StructType([T.StructField(f.name, f.dataType) for f in self.frame(name).schema.fields if any(f.name in r for r in rows)])

    def upsert_where(self, name: str, where, data: dict, new_id: str) -> None:
        test = self._where(name, where)
        self._apply(name, lambda old: old.filter(test | F.col("id").eqNullSafe(F.lit(new_id))), lambda old: mutate.upsert_where(old, lambda w: test, data, new_id))

    def _written(self, df: DataFrame) -> DataFrame:
        """df read back from the shared folder, so that rounds don't pile up in one plan."""
        path = f"{shared.folder(self.spark)}/karst-gone-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, target: str, where=None, limit: int | None = None) -> None:
        """Deletes one row (table:key), the matching rows or all, and follows the links to them as far as they cascade."""
        name, colon, _ = target.partition(":")
        test = self._where(name, (lambda w: w.eq("id", target)) if colon else where)
        links = [(t.name, link, to, f.on_delete) for t in self.tables.values() for link, f in t.links().items() for to in f.targets if f.on_delete != "ignore"]
        if not links:
            self._apply(name, lambda old: old.filter(test), lambda old: mutate.delete(old, lambda w: test, limit))
            return
        old = self._all(name)
        left = mutate.delete(old, lambda w: test, limit)
        fresh = {name: self._written(old.join(left.select("id"), "id", "left_anti").select("id"))}
        gone = dict(fresh)
        while fresh:
            found: dict[str, DataFrame] = {}
            for other, link, to, action in links:
                if action == "cascade" and to in fresh:
                    ids = fresh[to].select(F.col("id").alias("_gone"))
                    hit = self._all(other).join(ids, F.col(link) == F.col("_gone"), "left_semi").select("id")
                    found[other] = found[other].unionByName(hit) if other in found else hit
            fresh = {}
            for other, ids in found.items():
                ids = ids.distinct()
                ids = self._written(ids.join(gone[other], "id", "left_anti") if other in gone else ids)
                if not ids.isEmpty():
                    fresh[other] = ids
                    gone[other] = gone[other].unionByName(ids) if other in gone else ids
        after = {t: self._all(t).join(ids, "id", "left_anti").select(*self._all(t).columns) for t, ids in gone.items()}
        for other, link, to, action in links:
            if action != "cascade" and to in gone:
                after[other] = mutate.on_delete(after.get(other, self._all(other)), link, gone[to], action)
        for other in [t for t in after if t != name] + [name]:
            self._write(other, after[other])

    def relate(self, source: str, edge: str, target: str, data: dict | None = None) -> None:
        pair = self.spark.createDataFrame([(source, target)], "`in` string, out string")
        self._apply(edge, lambda old: old.filter(F.lit(False)), lambda old: mutate.relate(old, pair, data, edge))

    # -- transactions: writes are staged and recorded together; each table's log is atomic by itself
    def begin(self) -> None:
        if self.staged is not None:
            raise RuntimeError("a transaction is open")
        self.staged = {}

    def commit(self) -> None:
        staged, self.staged = self.staged, None
        if staged is None:
            raise RuntimeError("no transaction is open")
        self._commit(staged)

    def cancel(self) -> None:
        if self.staged is None:
            raise RuntimeError("no transaction is open")
        self.staged = None

    def __enter__(self) -> Database:
        self.begin()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.cancel() if kind else self.commit()

    def transaction(self, work: Callable[[Database], Any]) -> Any:
        with self:
            return work(self)

    # -- statements
    def return_(self, expression: str) -> Any:
        return self.query(f"SELECT {expression} AS value").first()[0]

    def throw(self, message: str) -> None:
        raise RuntimeError(message)

    def use(self, catalog: str | None = None, schema: str | None = None) -> None:
        if catalog:
            self.spark.catalog.setCurrentCatalog(catalog)
        if schema:
            self.spark.catalog.setCurrentDatabase(schema)

    def info(self, table: str | None = None) -> DataFrame:
        """(name, kind, optional, links) of a table's fields, or (name, mode, fields) of all tables."""
        if table is None:
            rows = [(t.name, t.mode, len(t.all_fields)) for t in self.tables.values()]
            return self.spark.createDataFrame(rows, "name string, mode string, fields int")
        t = self.tables.get(table)
        found = t.all_fields if t else {f.name: None for f in self.frame(table).schema.fields}
        kinds = {f.name: f.dataType.simpleString() for f in (t.struct() if t else self.frame(table).schema).fields}
        rows = [(n, kinds[n], bool(f.optional) if f else True, ",".join(f.targets) if f else "") for n, f in found.items()]
        return self.spark.createDataFrame(rows, "name string, kind string, optional boolean, links string")

    def show_changes(self, table: str, since: int = 0, limit: int = 10) -> DataFrame:
        return self.store.show_changes(table, since, limit)

    def live(self, table: str):
        return self.store.live(table)
