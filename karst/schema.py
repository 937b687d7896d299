"""Typed tables and relations, and what they ask of rows that are written.

A table is a name, fields and a mode: ``full`` drops undeclared columns, ``less``
keeps them.  Every table has an ``id`` of the form table:key besides.  Relations
have ``in`` and ``out`` as well, each a link to one of some tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])

#: Kinds and their Spark types.
KINDS: dict[str, T.DataType] = {
    **{k: T.StringType() for k in ("string", "uuid", "regex", "table", "file", "literal", "record")},
    "int": T.LongType(),
    "float": T.DoubleType(),
    "number": T.DoubleType(),
    "decimal": T.DecimalType(38, 18),
    "bool": T.BooleanType(),
    "datetime": T.TimestampType(),
    "duration": T.DayTimeIntervalType(),
    "bytes": T.BinaryType(),
    "any": T.VariantType(),
    "null": T.NullType(),
    "point": POINT,
    "geometry": T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.VariantType())]),
    "range": T.StructType([T.StructField("beg", T.LongType()), T.StructField("end", T.LongType()), T.StructField("beg_incl", T.BooleanType()), T.StructField("end_incl", T.BooleanType())]),
}
ALIASES = {"integer": "int", "boolean": "bool", "date": "datetime", "time": "datetime", "timestamp": "datetime", "double": "float"}
ON_DELETE = ("ignore", "cascade", "set_null", "restrict")


def canonical(kind: str) -> str:
    kind = ALIASES.get(kind, kind)
    if kind not in KINDS and kind not in ("array", "set", "tuple", "object"):
        raise ValueError(f"unknown kind {kind!r}")
    return kind


@dataclass(frozen=True)
class Field:
    """A declared column; the methods return changed copies."""

    kind: str
    of: tuple = ()  # item of array and set, items of tuple, (name, Field) pairs of object, values of literal
    optional: bool = False
    default: Any = None
    default_sql: str | None = None
    check: str | None = None  # Spark SQL in which `value` stands for the column
    readonly: bool = False
    flexible: bool = False
    unique: bool = False
    targets: tuple[str, ...] = ()
    on_delete: str = "ignore"
    comment: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "kind", canonical(self.kind))
        if self.flexible and self.kind != "object":
            raise ValueError("only objects can be flexible")
        if self.on_delete not in ON_DELETE:
            raise ValueError(f"on_delete is one of {ON_DELETE}")

    def nullable(self) -> Field:
        return replace(self, optional=True)

    def with_default(self, value: Any) -> Field:
        return replace(self, default=value)

    def default_now(self) -> Field:
        return replace(self, default_sql="current_timestamp()")

    def asserts(self, sql: str) -> Field:
        return replace(self, check=sql)

    def read_only(self) -> Field:
        return replace(self, readonly=True)

    def is_unique(self) -> Field:
        return replace(self, unique=True)

    def deletes(self, action: str) -> Field:
        return replace(self, on_delete=action)

    def spark_type(self) -> T.DataType:
        if self.kind in ("array", "set"):
            return T.ArrayType(self.of[0].spark_type() if self.of else T.VariantType())
        if self.kind == "tuple":
            return T.StructType([T.StructField(f"_{i}", f.spark_type(), f.optional) for i, f in enumerate(self.of)])
        if self.kind == "object":
            if self.flexible or not self.of:
                return T.VariantType()
            return T.StructType([T.StructField(n, f.spark_type(), f.optional) for n, f in self.of])
        return KINDS[self.kind]

    def struct_field(self, name: str) -> T.StructField:
        meta = {k: v for k, v in (("recordTable", list(self.targets)), ("onDelete", self.on_delete if self.targets else None), ("readonly", self.readonly), ("unique", self.unique), ("check", self.check)) if v}
        return T.StructField(name, self.spark_type(), self.optional, meta)

    def requirement(self, name: str) -> Column:
        """What a written value must fulfil."""
        value = F.col(name)
        ok = value.isNotNull() if not self.optional else F.lit(True)
        if self.kind == "literal":
            ok = ok & (value.isNull() | value.isin(*self.of))
        if self.targets:
            ok = ok & (value.isNull() | F.substring_index(value, ":", 1).isin(*self.targets))
        if self.check:
            ok = ok & F.coalesce(value.isNull() | F.expr(_bound(self.check, name)), F.lit(False))
        return ok


def _bound(sql: str, name: str) -> str:
    import re

    return re.sub(r"\bvalue\b", f"`{name}`", sql)


def _maker(kind: str):
    def make(**options) -> Field:
        return Field(kind, **options)

    return make


string, int_, float_, bool_, datetime, duration = (_maker(k) for k in ("string", "int", "float", "bool", "datetime", "duration"))
decimal, uuid, bytes_, point, any_, number, geometry = (_maker(k) for k in ("decimal", "uuid", "bytes", "point", "any", "number", "geometry"))


def array(of: Field | None = None, **options) -> Field:
    return Field("array", (of,) if of else (), **options)


def set_(of: Field | None = None, **options) -> Field:
    return Field("set", (of,) if of else (), **options)


def tuple_(*of: Field, **options) -> Field:
    return Field("tuple", of, **options)


def object_(fields: dict[str, Field] | None = None, **options) -> Field:
    return Field("object", tuple((fields or {}).items()), **options)


def literal(*values: str, **options) -> Field:
    return Field("literal", values, **options)


def record(*tables: str, **options) -> Field:
    """A link to a row of one of some tables."""
    return Field("record", targets=tables, **options)


@dataclass(frozen=True)
class Index:
    """Metadata: kind is plain, unique, fulltext or vector; options as the kind needs (analyzer, dimension, distance)."""

    name: str
    fields: tuple[str, ...]
    kind: str = "plain"
    options: tuple = ()


@dataclass(frozen=True)
class Table:
    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    mode: str = "full"
    permissions: dict[str, str] = field(default_factory=dict)  # verb -> Spark SQL predicate
    indexes: tuple[Index, ...] = ()
    changefeed: str | None = None
    sources: tuple[str, ...] = ()  # relations only: tables of in and of out
    targets: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.name.isidentifier():
            raise ValueError(f"bad table name {self.name!r}")
        if self.mode not in ("full", "less"):
            raise ValueError("mode is full or less")
        if self.changefeed is not None:
            from .functions.time import micros_of

            micros_of(self.changefeed)
        if unknown := set(self.permissions) - {"select", "create", "update", "delete"}:
            raise ValueError(f"unknown permissions {sorted(unknown)}")

    @property
    def is_relation(self) -> bool:
        return bool(self.sources or self.targets)

    @property
    def all_fields(self) -> dict[str, Field]:
        links = {"in": record(*self.sources), "out": record(*self.targets)} if self.is_relation else {}
        return {"id": string(), **links, **{n: f for n, f in self.fields.items() if n != "id"}}

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field(n) for n, f in self.all_fields.items()])

    def unique_keys(self) -> list[tuple[str, ...]]:
        return [(n,) for n, f in self.fields.items() if f.unique] + [i.fields for i in self.indexes if i.kind == "unique"]

    def links(self) -> dict[str, Field]:
        return {n: f for n, f in self.all_fields.items() if f.targets}

    def conform(self, df: DataFrame, defaults: bool = True) -> DataFrame:
        """df with the declared columns and types, defaults filled in, and rows that break a rule raising an error."""
        columns = []
        for name, f in self.all_fields.items():
            kind = f.spark_type()
            value = F.col(f"`{name}`") if name in df.columns else F.lit(None)
            value = value.cast(kind)
            if f.kind == "set":
                value = F.array_sort(F.array_distinct(value))
            if defaults and name != "id" and (f.default is not None or f.default_sql):
                value = F.coalesce(value, (F.expr(f.default_sql) if f.default_sql else F.lit(f.default)).cast(kind))
            columns.append(value.alias(name))
        extra = [F.col(f"`{c}`") for c in df.columns if c not in self.all_fields] if self.mode == "less" else []
        out = df.select(*columns, *extra)
        for name, f in self.all_fields.items():
            if name == "id":
                continue
            rule = f.requirement(f"{name}")
            message = F.concat(F.lit(f"{self.name}.{name}: value not allowed: "), F.coalesce(F.to_json(F.struct(F.col(name).alias("value"))) if not isinstance(f.spark_type(), (T.VariantType, T.NullType)) else F.lit("?"), F.lit("NULL")))
            out = out.withColumn(name, F.when(rule, F.col(name)).otherwise(F.raise_error(message).cast(f.spark_type())))
        return out

    def visible(self, df: DataFrame, verb: str = "select") -> DataFrame:
        """The rows that the verb's permission lets through."""
        return df.filter(F.expr(self.permissions[verb])) if verb in self.permissions else df


def relation(name: str, sources: tuple[str, ...] | str, targets: tuple[str, ...] | str, fields: dict[str, Field] | None = None, **options) -> Table:
    """An edge table."""
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Table(name, fields or {}, sources=as_tuple(sources), targets=as_tuple(targets), **options)


def infer(name: str, df: DataFrame) -> Table:
    """The table that a DataFrame's schema amounts to."""

    def of(t: T.DataType, optional: bool) -> Field:
        if isinstance(t, T.ArrayType):
            return array(of(t.elementType, t.containsNull), optional=optional)
        if t == POINT:
            return point(optional=optional)
        if isinstance(t, T.StructType):
            return object_({f.name: of(f.dataType, f.nullable) for f in t.fields}, optional=optional)
        if isinstance(t, T.DecimalType):
            return decimal(optional=optional)
        kinds = {"string": "string", "boolean": "bool", "double": "float", "float": "float", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime", "binary": "bytes", "variant": "any", "void": "null"}
        s = t.simpleString()
        return Field("duration" if s.startswith("interval") else kinds.get(s, "int" if s in ("bigint", "int", "smallint", "tinyint") else "any"), optional=optional)

    links = {f.name: tuple(f.metadata.get("recordTable", ())) for f in df.schema.fields}
    fields = {f.name: (record(*links[f.name], optional=f.nullable) if links[f.name] else of(f.dataType, f.nullable)) for f in df.schema.fields if f.name != "id"}
    return Table(name, fields)


def split_id(rid: str) -> tuple[str, str]:
    """(table, key) of a record id; the first colon splits, the key may be in angle brackets."""
    table, colon, key = rid.partition(":")
    if not colon or not table or not key:
        raise ValueError(f"not a record id: {rid!r}")
    if key.startswith("⟨") and key.endswith("⟩"):
        key = key[1:-1]
    if "<" in key or ">" in key:
        raise ValueError(f"angle brackets in a key: {rid!r}")
    return table, key
