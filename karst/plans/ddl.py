"""Schemas as data: snapshots, differences, ordered statements, migrations with a journal."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..schema import Field, Index, Table, infer


@dataclass
class Model:
    """A schema: tables and the objects beside them, each by name."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)  # name -> SELECT
    functions: dict[str, str] = field(default_factory=dict)  # name -> "(args) RETURNS type RETURN body"
    sequences: dict[str, dict] = field(default_factory=dict)
    events: dict[str, dict] = field(default_factory=dict)
    analyzers: dict[str, dict] = field(default_factory=dict)

    def add(self, table: Table) -> Model:
        self.tables[table.name] = table
        return self


@dataclass(frozen=True)
class Change:
    """One step. kind: create, drop or alter and what of; loses: whether rows or values can be lost."""

    kind: str
    name: str
    detail: str = ""
    sql: str = ""
    loses: bool = False


#: Drops come before creates, so an object that has changed is dropped and made again.
ORDER = ("drop_event", "drop_view", "drop_function", "drop_index", "drop_column", "drop_table", "drop_sequence", "drop_analyzer", "create_analyzer", "create_sequence", "create_table", "add_column", "alter_column", "alter_table", "create_index", "create_function", "create_view", "create_event")


def _column(name: str, f: Field) -> str:
    rule = "" if f.optional else " NOT NULL"
    return f"`{name}` {f.spark_type().simpleString().replace('interval day to second', 'interval day to second')}{rule}"


def create_table_sql(t: Table) -> str:
    columns = ", ".join(_column(n, f) for n, f in t.all_fields.items())
    properties = {"karst.mode": t.mode, **({"karst.changefeed": t.changefeed} if t.changefeed else {}), **({"karst.in": ",".join(t.sources), "karst.out": ",".join(t.targets)} if t.is_relation else {})}
    text = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    return f"CREATE TABLE `{t.name}` ({columns}) USING parquet TBLPROPERTIES ({text})"


def _widens(a: T.DataType, b: T.DataType) -> bool:
    order = ["tinyint", "smallint", "int", "bigint"]
    x, y = a.simpleString(), b.simpleString()
    return x in order and y in order and order.index(x) <= order.index(y) or (x, y) == ("float", "double")


def _index_sql(t: str, i: Index) -> str:
    return f"ALTER TABLE `{t}` SET TBLPROPERTIES ('karst.index.{i.name}' = '{i.kind}:{','.join(i.fields)}')"


def diff(old: Model, new: Model) -> list[Change]:
    """The steps from one schema to another, in an order in which they can run."""
    out: list[Change] = []
    for name in old.tables.keys() | new.tables.keys():
        a, b = old.tables.get(name), new.tables.get(name)
        if b is None:
            out.append(Change("drop_table", name, sql=f"DROP TABLE `{name}`", loses=True))
            continue
        if a is None:
            out.append(Change("create_table", name, sql=create_table_sql(b)))
            out += [Change("create_index", f"{name}.{i.name}", i.kind, _index_sql(name, i)) for i in b.indexes]
            continue
        fa, fb = a.all_fields, b.all_fields
        for c in fa.keys() | fb.keys():
            at = f"{name}.{c}"
            if c not in fb:
                out.append(Change("drop_column", at, sql=f"ALTER TABLE `{name}` DROP COLUMN `{c}`", loses=True))
            elif c not in fa:
                # a column that must have a value needs a default for the rows there are
                bare = not fb[c].optional and fb[c].default is None and not fb[c].default_sql
                kind = fb[c].spark_type().simpleString()
                out.append(Change("add_column", at, kind, f"ALTER TABLE `{name}` ADD COLUMN `{c}` {kind}", bare))
            elif fa[c] != fb[c]:
                x, y = fa[c].spark_type(), fb[c].spark_type()
                narrows = x != y and not _widens(x, y) or fa[c].optional and not fb[c].optional
                detail = f"{x.simpleString()} to {y.simpleString()}" if x != y else "rules"
                sql = f"ALTER TABLE `{name}` ALTER COLUMN `{c}` TYPE {y.simpleString()}" if x != y else ""
                out.append(Change("alter_column", at, detail, sql, narrows))
        ia, ib = {i.name: i for i in a.indexes}, {i.name: i for i in b.indexes}
        for i in ia.keys() | ib.keys():
            if ia.get(i) != ib.get(i):
                if i in ia:
                    out.append(Change("drop_index", f"{name}.{i}", sql=f"ALTER TABLE `{name}` UNSET TBLPROPERTIES ('karst.index.{i}')"))
                if i in ib:
                    out.append(Change("create_index", f"{name}.{i}", ib[i].kind, _index_sql(name, ib[i])))
        settings = lambda t: (t.mode, t.permissions, t.changefeed, t.sources, t.targets)
        if settings(a) != settings(b):
            out.append(Change("alter_table", name, "settings", f"ALTER TABLE `{name}` SET TBLPROPERTIES ('karst.mode' = '{b.mode}')"))
    makers = {
        "view": (lambda n, v: f"CREATE OR REPLACE VIEW `{n}` AS {v}", lambda n: f"DROP VIEW `{n}`"),
        "function": (lambda n, v: f"CREATE OR REPLACE TEMPORARY FUNCTION {n}{v}", lambda n: f"DROP TEMPORARY FUNCTION {n}"),
        "sequence": (lambda n, v: "", lambda n: ""),
        "event": (lambda n, v: "", lambda n: ""),
        "analyzer": (lambda n, v: "", lambda n: ""),
    }
    for kind, (make, drop) in makers.items():
        x, y = getattr(old, f"{kind}s"), getattr(new, f"{kind}s")
        for n in x.keys() | y.keys():
            if x.get(n) != y.get(n):
                if n in x:
                    out.append(Change(f"drop_{kind}", n, sql=drop(n), loses=kind == "sequence"))
                if n in y:
                    out.append(Change(f"create_{kind}", n, str(y[n]), make(n, y[n])))
    return sorted(out, key=lambda c: (ORDER.index(c.kind), c.name))


def losses(changes: list[Change]) -> list[str]:
    return [f"{c.kind} {c.name}" for c in changes if c.loses]


# -- snapshots
def snapshot(model: Model) -> str:
    """A schema as JSON text."""
    return json.dumps(asdict(model), sort_keys=True, indent=1)


def _field(x: dict) -> Field:
    def item(o):
        if isinstance(o, dict):
            return _field(o)
        if isinstance(o, list) and len(o) == 2 and isinstance(o[1], dict):
            return o[0], _field(o[1])
        return o

    return Field(**{**x, "of": tuple(map(item, x["of"])), "targets": tuple(x["targets"])})


def restore(text: str) -> Model:
    raw = json.loads(text)
    tables = {}
    for n, t in raw.pop("tables").items():
        fields = {k: _field(f) for k, f in t["fields"].items()}
        indexes = tuple(Index(i["name"], tuple(i["fields"]), i["kind"], tuple(map(tuple, i["options"]))) for i in t["indexes"])
        tables[n] = Table(**{**t, "fields": fields, "indexes": indexes, "sources": tuple(t["sources"]), "targets": tuple(t["targets"])})
    return Model(tables, **raw)


def introspect(spark: SparkSession, schema: str | None = None) -> Model:
    """The tables of a catalog's schema."""
    model = Model()
    for t in spark.catalog.listTables(schema):
        if not t.isTemporary and t.tableType != "VIEW":
            model.add(infer(t.name, spark.table(f"`{schema}`.`{t.name}`" if schema else f"`{t.name}`")))
    return model


# -- migrations
def statements(text: str) -> list[str]:
    """SQL text cut at semicolons outside quotes, comments and BEGIN ... END blocks."""
    out, at, depth = [], 0, 0
    marks = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\bBEGIN\b|\bEND\b|;", re.S | re.I)
    for m in marks.finditer(text):
        word = m[0].upper()
        depth += (word == "BEGIN") - (word == "END" and depth > 0)
        if word == ";" and not depth:
            out.append(text[at : m.start()].strip())
            at = m.end()
    out.append(text[at:].strip())
    bare = lambda s: re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
    return [s for s in out if bare(s)]


DESTRUCTIVE = re.compile(r"^\s*(DROP\s+(TABLE|SCHEMA|DATABASE|VIEW|COLUMN)|TRUNCATE|DELETE\b|ALTER\s+TABLE\b.*\bDROP\b)", re.I | re.S)


def destructive(text: str) -> list[str]:
    return [s for s in statements(text) if DESTRUCTIVE.search(s)]


class Migrations:
    """Folders ``<version>_<name>/migration.sql`` and a journal beside them; applied ones are rows of a table."""

    TABLE = "karst_migrations"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.journal = self.folder / "journal.json"

    def entries(self) -> list[dict]:
        return json.loads(self.journal.read_text())["entries"] if self.journal.exists() else []

    def generate(self, name: str, old: Model, new: Model, allow_loss: bool = False) -> str | None:
        """Writes the migration that leads from old to new; None if they are equal."""
        steps = diff(old, new)
        if not steps:
            return None
        if losses(steps) and not allow_loss:
            raise ValueError("would lose data: " + ", ".join(losses(steps)))
        entries = self.entries()
        tag = f"{len(entries):04d}_{name}"
        text = "".join(f"-- {c.kind} {c.name}\n{c.sql};\n" for c in steps if c.sql)
        (self.folder / tag).mkdir(parents=True)
        (self.folder / tag / "migration.sql").write_text(text)
        (self.folder / tag / "snapshot.json").write_text(snapshot(new))
        entries.append({"idx": len(entries), "tag": tag, "hash": hashlib.sha256(text.encode()).hexdigest()})
        self.journal.write_text(json.dumps({"entries": entries}, indent=1))
        return tag

    def latest(self) -> Model:
        entries = self.entries()
        return restore((self.folder / entries[-1]["tag"] / "snapshot.json").read_text()) if entries else Model()

    def _applied(self) -> dict[str, str]:
        if not self.spark.catalog.tableExists(self.TABLE):
            self.spark.sql(f"CREATE TABLE {self.TABLE} (tag STRING, hash STRING, done INT, applied_at TIMESTAMP) USING parquet")
        rows = self.spark.table(self.TABLE).groupBy("tag").agg({"hash": "max", "done": "max"}).collect()
        return {r["tag"]: (r["max(hash)"], r["max(done)"]) for r in rows}

    def status(self) -> list[tuple[str, str]]:
        """(tag, applied, partial, changed or pending) of every migration."""
        applied = self._applied()
        out = []
        for e in self.entries():
            text = (self.folder / e["tag"] / "migration.sql").read_text()
            found, done = applied.get(e["tag"], (None, 0))
            state = "pending" if found is None else "changed" if found != hashlib.sha256(text.encode()).hexdigest() else "applied" if done >= len(statements(text)) else "partial"
            out.append((e["tag"], state))
        return out

    def up(self) -> list[str]:
        """Applies what is pending, in order; one that broke off goes on after its last finished statement."""
        ran = []
        for tag, state in self.status():
            if state == "changed":
                raise ValueError(f"{tag} was changed after it was applied")
            if state == "applied":
                continue
            text = (self.folder / tag / "migration.sql").read_text()
            digest = hashlib.sha256(text.encode()).hexdigest()
            done = self._applied().get(tag, (None, 0))[1]
            steps = statements(text)
            for k in range(done, len(steps)):
                self.spark.sql(steps[k])
                self.spark.sql(f"INSERT INTO {self.TABLE} VALUES ('{tag}', '{digest}', {k + 1}, current_timestamp())")
            ran.append(tag)
        return ran

    def shadow(self, schema: str = "karst_shadow") -> list[str]:
        """Tries all migrations in a scratch schema, which is dropped; returns the errors."""
        back = self.spark.catalog.currentDatabase()
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
        self.spark.catalog.setCurrentDatabase(schema)
        errors = []
        try:
            for e in self.entries():
                for s in statements((self.folder / e["tag"] / "migration.sql").read_text()):
                    try:
                        self.spark.sql(s)
                    except Exception as error:
                        errors.append(f"{e['tag']}: {str(error).splitlines()[0]}")
        finally:
            self.spark.catalog.setCurrentDatabase(back)
            self.spark.sql(f"DROP SCHEMA {schema} CASCADE")
        return errors


class SchemaBuilder:
    """Runtime definitions, run one after another."""

    def __init__(self) -> None:
        self.steps: list[str] = []

    def define_table(self, t: Table) -> SchemaBuilder:
        self.steps.append(create_table_sql(t))
        return self

    def define_field(self, table: str, name: str, f: Field) -> SchemaBuilder:
        self.steps.append(f"ALTER TABLE `{table}` ADD COLUMN `{name}` {f.spark_type().simpleString()}")
        return self

    def define_index(self, table: str, index: Index) -> SchemaBuilder:
        self.steps.append(_index_sql(table, index))
        return self

    def remove_table(self, table: str) -> SchemaBuilder:
        self.steps.append(f"DROP TABLE IF EXISTS `{table}`")
        return self

    def remove_field(self, table: str, name: str) -> SchemaBuilder:
        self.steps.append(f"ALTER TABLE `{table}` DROP COLUMN `{name}`")
        return self

    def remove_index(self, table: str, name: str) -> SchemaBuilder:
        self.steps.append(f"ALTER TABLE `{table}` UNSET TBLPROPERTIES ('karst.index.{name}')")
        return self

    def raw(self, sql: str) -> SchemaBuilder:
        self.steps.append(sql)
        return self

    def to_sql(self) -> str:
        return ";\n".join(self.steps) + ";" * bool(self.steps)

    def execute(self, spark: SparkSession) -> None:
        for s in self.steps:
            spark.sql(s)
