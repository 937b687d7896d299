"""A fluent SELECT. Each call returns a new builder; ``df()`` composes the DataFrame, Catalyst does the rest.

Clauses apply in this order, whatever order they are called in: source, permission,
version, links and edges, WHERE, GROUP BY, SPLIT, fields, OMIT, ORDER BY,
START, LIMIT, FETCH, set operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import predicates
from ..operators import graph, search
from . import setops


@dataclass(frozen=True)
class Step:
    edge: str
    target: str
    to: str
    direction: str
    depth: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class Select:
    source: Any  # what gives tables: has frame(name), table(name) and spark
    name: str
    parts: tuple = ()
    projection: tuple = ()
    dropped: tuple[str, ...] = ()
    conditions: tuple = ()
    groups: tuple = ()
    split_on: tuple[str, ...] = ()
    order: tuple = ()
    count: int | None = None
    skip: int = 0
    links: tuple[tuple[str, str | None], ...] = ()
    steps: tuple[Step, ...] = ()
    ctes: dict[str, Any] = field(default_factory=dict)
    operations: tuple = ()
    seconds: float | None = None
    at_version: int | None = None
    keep_empty: bool = False
    near: tuple | None = None

    # -- projection
    def fields(self, *names: str | Column) -> Select:
        """What to return, in place of all columns: names, SQL text or columns."""
        return replace(self, projection=names)

    def columns(self, mapping: dict[str, str | Column]) -> Select:
        """What to return, by alias."""
        return replace(self, projection=tuple((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()))

    def omit(self, *names: str) -> Select:
        return replace(self, dropped=self.dropped + names)

    def value(self, name: str) -> Select:
        return self.fields(name)

    # -- rows
    def where(self, condition) -> Select:
        """A callback, a column or text; several calls must all hold."""
        return replace(self, conditions=(*self.conditions, condition))

    def where_behind(self, hops: list[tuple[str, str]], target: str, condition) -> Select:
        """Rows from which hops, each (edge, direction), lead to a row of target that fulfils a condition."""

        def test(w) -> Column:
            rows = self._frame(target)
            found = graph.behind([(self._frame(e), d) for e, d in hops], rows.filter(predicates.resolve(rows, condition)))
            return w.in_query("id", found)

        return self.where(test)

    def nearest(self, name: str, vector: list[float], k: int, distance: str = "cosine", to: str = "distance") -> Select:
        """Of the rows that all conditions leave, the k nearest to a vector."""
        return replace(self, near=(name, vector, k, distance, to))

    def group_by(self, *names: str | Column) -> Select:
        return replace(self, groups=names)

    def split(self, *names: str, keep_empty: bool = False) -> Select:
        """One row for each item of an array; rows without items go, unless kept."""
        return replace(self, split_on=self.split_on + names, keep_empty=keep_empty)

    def order_by(self, name: str | Column, direction: str = "asc") -> Select:
        """NULL comes first ascending, last descending."""
        if direction.lower() not in ("asc", "desc"):
            raise ValueError("direction is asc or desc")
        c = F.col(name) if isinstance(name, str) else name
        return replace(self, order=(*self.order, (c, direction.lower())))

    def limit(self, n: int) -> Select:
        if n < 0:
            raise ValueError("a limit is 0 or more")
        return replace(self, count=n)

    def start(self, n: int) -> Select:
        if n < 0:
            raise ValueError("a start is 0 or more")
        return replace(self, skip=n)

    # -- links and edges
    def fetch(self, *names: str, target: str | None = None) -> Select:
        """Links give way to the rows they point to."""
        return replace(self, links=self.links + tuple((n, target) for n in names))

    def _step(self, edge: str, target: str | None, to: str | None, direction: str, depth) -> Select:
        if depth is not None:
            graph.check_depth(*depth)
        return replace(self, steps=(*self.steps, Step(edge, target or to or edge, to or target or edge, direction, depth)))

    def out(self, edge: str, target: str | None = None, to: str | None = None, depth: tuple[int, int | None] | None = None) -> Select:
        return self._step(edge, target, to, "out", depth)

    def in_(self, edge: str, target: str | None = None, to: str | None = None, depth: tuple[int, int | None] | None = None) -> Select:
        return self._step(edge, target, to, "in", depth)

    # -- CTEs, subqueries and set operations
    def with_(self, name: str, query: Select | DataFrame) -> Select:
        """Names a query; the name can be a source, a link's target or an edge's."""
        return replace(self, ctes={**self.ctes, name: query})

    def union(self, other) -> Select:
        return replace(self, operations=(*self.operations, ("union", other)))

    def union_all(self, other) -> Select:
        return replace(self, operations=(*self.operations, ("union_all", other)))

    def intersect(self, other) -> Select:
        return replace(self, operations=(*self.operations, ("intersect", other)))

    def except_(self, other) -> Select:
        return replace(self, operations=(*self.operations, ("except", other)))

    def subquery(self, alias: str | None = None) -> Column:
        """The single value of this query; more than one row is an error."""
        found = self.df().scalar()
        return found.alias(alias) if alias else found

    # -- statement options
    def timeout(self, seconds: float) -> Select:
        if seconds <= 0:
            raise ValueError("a timeout is more than 0")
        return replace(self, seconds=seconds)

    def version(self, number: int) -> Select:
        """Reads the table as it was after change ``number``."""
        return replace(self, at_version=number)

    def parallel(self) -> Select:
        """No effect: Spark is parallel."""
        return self

    def temp_files(self) -> Select:
        """No effect: Spark spills as it must."""
        return self

    def with_index(self, *names: str) -> Select:
        """No effect: there are no indexes to choose from."""
        return self

    def no_index(self) -> Select:
        return self

    # -- the plan
    def _frame(self, name: str) -> DataFrame:
        if name in self.ctes:
            query = self.ctes[name]
            if isinstance(query, Select):
                query = replace(query, ctes={**{k: v for k, v in self.ctes.items() if k != name}, **query.ctes})
            return as_frame(query)
        if name == self.name and self.at_version is not None:
            return self.source.as_of(name, self.at_version)
        return self.source.frame(name)

    def df(self) -> DataFrame:
        df = self._frame(self.name)
        for s in self.steps:
            edges, targets = self._frame(s.edge), self._frame(s.target)
            if s.depth:
                reached = graph.reach(df.select("id"), edges, *s.depth, s.direction)
                pairs = reached.select(F.col("source").alias("in"), F.col("node").alias("out"))
                df = graph.step(df, pairs, targets, s.to)
            else:
                df = graph.step(df, edges, targets, s.to, s.direction)
        for condition in self.conditions:
            df = df.filter(predicates.resolve(df, condition))
        shown = [F.expr(p) if isinstance(p, str) and not p.isidentifier() else F.col(p) if isinstance(p, str) else p for p in self.projection]
        if self.groups:
            keys = [F.col(g) if isinstance(g, str) else g for g in self.groups]
            names = {g for g in self.groups if isinstance(g, str)}
            found = [p for p, given in zip(shown, self.projection) if not (isinstance(given, str) and given in names)]
            df = df.groupBy(*keys).agg(*found) if found else df.select(*keys).distinct()
        for name in self.split_on:
            explode = F.explode_outer if self.keep_empty else F.explode
            df = df.withColumn(name, explode(name))
        if shown and not self.groups:
            df = df.select(*shown)
        if self.dropped:
            df = df.drop(*self.dropped)
        places = [f"_place{i}" for i in range(len(self.order))]
        if self.order and self.links:
            # the joins that follow may deal rows out anew: what they are sorted by goes along
            df = df.select("*", *(c.alias(p) for p, (c, _) in zip(places, self.order)))
            sorts = [F.col(p).asc() if d == "asc" else F.col(p).desc() for p, (_, d) in zip(places, self.order)]
        else:
            sorts = [c.asc() if d == "asc" else c.desc() for c, d in self.order]
        if sorts:
            df = df.orderBy(*sorts)
        if self.near:
            field, vector, k, distance, to = self.near
            df = search.nearest(df, field, vector, k, distance, to)
        if self.skip:
            df = df.offset(self.skip)
        if self.count is not None:
            df = df.limit(self.count)
        for name, target in self.links:
            df = graph.fetch(df, name, self._frame(target or self._target(name)))
        if sorts and self.links:
            df = df.orderBy(*sorts).drop(*places)
        for kind, other in self.operations:
            df = setops.OPERATIONS[kind](df, as_frame(other))
        return df

    def _target(self, link: str) -> str:
        table = self.source.table(self.name)
        f = table.all_fields.get(link) if table else None
        if not f or len(f.targets) != 1:
            raise ValueError(f"name the table that {link} links to")
        return f.targets[0]

    def explain(self, full: bool = False) -> str:
        """The plan as text."""
        return self.df()._sc._jvm.PythonSQLUtils.explainString(self.df()._jdf.queryExecution(), "extended" if full else "formatted")

    def collect(self) -> list:
        """Runs the query; a timeout cancels its jobs."""
        df = self.df()
        if self.seconds is None:
            return df.collect()
        import threading
        import uuid

        tag = f"karst-{uuid.uuid4().hex}"
        spark = df.sparkSession
        timer = threading.Timer(self.seconds, lambda: spark.interruptTag(tag))
        spark.addTag(tag)
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            spark.removeTag(tag)


def as_frame(query) -> DataFrame:
    return query.df() if isinstance(query, Select) else query
