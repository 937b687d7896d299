"""One query for each operator of the query layer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..database import Database
from ..functions import count, math, type_
from ..operators import graph, mutate, numbering, search
from ..plans.select import Select
from ..sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Files(Database):
    """The given tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.dir = sf_dir

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames and name in TABLES:
            self.frames[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return super().frame(name)


def query(sql: str | None, name: str | None = None):
    """Registers a function of the tables: f(db) gives a Select or a DataFrame."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Files(spark, sf_dir))
            return found.df() if isinstance(found, Select) else found

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return register


def simple(name: str, sql: str, f) -> None:
    query(sql, name)(f)


# -- scans and projection
simple("scan_all", "SELECT * FROM customer", lambda db: db.select("customer"))
simple("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 7", lambda db: db.select("orders").where(lambda w: w.eq("o_orderkey", 7)))
simple("project_fields", "SELECT c_custkey, c_name FROM customer", lambda db: db.select("customer").fields("c_custkey", "c_name"))
simple("project_expression", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer", lambda db: db.select("customer").fields("c_custkey", "c_acctbal * 2 AS twice"))
simple("columns_alias", "SELECT c_custkey AS k, c_name AS n FROM customer", lambda db: db.select("customer").columns({"k": "c_custkey", "n": "c_name"}))
simple("omit_fields", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer", lambda db: db.select("customer").omit("c_acctbal", "c_name"))
simple("value_single", "SELECT c_name FROM customer", lambda db: db.select("customer").value("c_name"))
simple("cast_expression", "SELECT o_orderkey, o_totalprice::BIGINT AS whole FROM orders WHERE o_totalprice = floor(o_totalprice)", lambda db: db.select("orders").where("o_totalprice = floor(o_totalprice)").fields("o_orderkey", "CAST(o_totalprice AS BIGINT) AS whole"))
simple("raw_query", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", lambda db: (db.frame("orders").createOrReplaceTempView("karst_orders"), db.query("SELECT o_orderkey FROM karst_orders WHERE o_totalprice > :least", least=100000))[1])
simple("split_tokens", "SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents", lambda db: Select(_Shown(db, tokens=lambda: db.frame("documents").select("doc_id", F.split("text", " ").alias("token"))), "tokens").split("token"))

# -- predicates
O = "SELECT o_orderkey FROM orders WHERE "  # noqa: E741


def _orders(name: str, sql: str, test) -> None:
    simple(name, O + sql, lambda db: db.select("orders").where(test).fields("o_orderkey"))


_orders("filter_eq", "o_orderstatus = 'F'", lambda w: w.eq("o_orderstatus", "F"))
_orders("filter_gt", "o_totalprice > 200000", lambda w: w.gt("o_totalprice", 200000))
_orders("filter_gte", "o_custkey >= 100", lambda w: w.gte("o_custkey", 100))
_orders("filter_lt", "o_totalprice < 5000", lambda w: w.lt("o_totalprice", 5000))
_orders("filter_lte", "o_custkey <= 100", lambda w: w.lte("o_custkey", 100))
_orders("filter_in_list", "o_orderpriority IN ('1-URGENT', '2-HIGH')", lambda w: w.in_("o_orderpriority", ["1-URGENT", "2-HIGH"]))
_orders("filter_contains_str", "contains(o_orderpriority, 'IG')", lambda w: w.contains("o_orderpriority", "IG"))
_orders("filter_like", "o_orderpriority LIKE '%O%'", lambda w: w.like("o_orderpriority", "%O%"))
_orders("filter_not_like", "o_orderpriority NOT LIKE '%O%'", lambda w: w.not_like("o_orderpriority", "%O%"))
_orders("filter_starts_ends", "starts_with(o_orderpriority, '1') OR ends_with(o_orderpriority, 'W')", lambda w: w.any_of(w.starts_with("o_orderpriority", "1"), w.ends_with("o_orderpriority", "W")))
_orders("filter_or", "o_orderstatus = 'F' OR o_totalprice > 300000", lambda w: w.any_of(w.eq("o_orderstatus", "F"), w.gt("o_totalprice", 300000)))
_orders("filter_and_or_nested", "o_orderstatus = 'O' AND (o_totalprice > 300000 OR o_custkey < 50)", lambda w: w.all_of(w.eq("o_orderstatus", "O"), w.any_of(w.gt("o_totalprice", 300000), w.lt("o_custkey", 50))))
_orders("filter_not", "NOT (o_orderstatus = 'F' AND o_custkey < 100)", lambda w: w.negate(w.all_of(w.eq("o_orderstatus", "F"), w.lt("o_custkey", 100))))
_orders("filter_raw", "o_custkey % 7 = 3 OR o_custkey % 11 = 1", "o_custkey % 7 = 3 OR o_custkey % 11 = 1")
_orders("filter_operator_text", "o_custkey > 100 AND o_orderstatus <> 'F'", lambda w: w.all_of(w.build("o_custkey", ">", 100), w.build("o_orderstatus", "!=", "F")))
simple("filter_col_to_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey", lambda db: db.select("lineitem").where(lambda w: w.eq("l_partkey", F.col("l_suppkey"))).fields("l_orderkey", "l_linenumber"))
# event_type with one value as NULL
EV = "SELECT event_id FROM (SELECT *, nullif(event_type, 'error') AS kind FROM events) WHERE "


def _events(name: str, sql: str, test) -> None:
    def run(db):
        db.frames["kinds"] = db.frame("events").withColumn("kind", F.nullif("event_type", F.lit("error")))
        return db.select("kinds").where(test).fields("event_id")

    simple(name, EV + sql, run)


_events("filter_ne", "kind IS DISTINCT FROM 'click'", lambda w: w.ne("kind", "click"))
_events("filter_is_null", "kind IS NULL", lambda w: w.is_null("kind"))
_events("filter_is_not_null", "kind IS NOT NULL", lambda w: w.is_not_null("kind"))
_events("filter_eq_null", "kind IS NULL", lambda w: w.eq("kind", None))
_events("filter_exactly", "kind IS NOT DISTINCT FROM nullif(event_type, 'error')", lambda w: w.exactly("kind", F.nullif("event_type", F.lit("error"))))


def _words(name: str, sql: str, test) -> None:
    def run(db):
        db.frames["words"] = db.frame("documents").select("doc_id", F.split("text", " ").alias("w"))
        return db.select("words").where(test).fields("doc_id")

    simple(name, f"SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents) WHERE {sql}", run)


_words("filter_contains_member", "list_contains(w, 'the')", lambda w: w.contains("w", "the"))
_words("filter_containsany", "list_has_any(w, ['the', 'der'])", lambda w: w.contains_any("w", ["the", "der"]))
_words("filter_containsall", "list_has_all(w, ['the', 'of'])", lambda w: w.contains_all("w", ["the", "of"]))
_words("filter_containsnone", "NOT list_has_any(w, ['the', 'der'])", lambda w: w.contains_none("w", ["the", "der"]))
_words("filter_inside_array", "list_contains(w, 'la')", lambda w: w.inside(F.lit("la"), F.col("w")))
simple("filter_intersects", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 80 BETWEEN 0 AND 39 AND s_suppkey % 70 < 40", lambda db: Select(_Shown(db, places=lambda: db.frame("supplier").select("s_suppkey", type_.point(F.col("s_suppkey") % 80 + 0.5, F.col("s_suppkey") % 70 + 0.5).alias("p"))), "places").where(lambda w: w.intersects(F.col("p"), F.array(*(type_.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (40, 0), (40, 40), (0, 40)))))).fields("s_suppkey"))
BIG = "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"
big = lambda db: db.select("orders").where(lambda w: w.gt("o_totalprice", 300000)).fields("o_custkey").df()
simple("in_subquery", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN {BIG}", lambda db: db.select("customer").where(lambda w: w.in_("c_custkey", big(db))).fields("c_custkey", "c_name"))
simple("not_in_subquery", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN {BIG}", lambda db: db.select("customer").where(lambda w: w.negate(w.in_("c_custkey", big(db)))).fields("c_custkey"))
simple("in_subquery_or", f"SELECT c_custkey FROM customer WHERE c_custkey IN {BIG} OR c_acctbal < 0", lambda db: db.select("customer").where(lambda w: w.any_of(w.in_("c_custkey", big(db)), w.lt("c_acctbal", 0))).fields("c_custkey"))
simple("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", lambda db: db.select("orders").where(F.col("o_totalprice") > db.select("orders").fields("avg(o_totalprice)").subquery()).fields("o_orderkey"))
simple("cte_single", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000", lambda db: Select(db, "rich").with_("rich", db.select("customer").where(lambda w: w.gt("c_acctbal", 9000)).fields("c_custkey", "c_name")))
simple("cte_multi", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 HAVING count(*) > 1", lambda db: Select(db, "counted").with_("large", db.select("orders").where(lambda w: w.gt("o_totalprice", 200000))).with_("counted", Select(db, "large").group_by("o_custkey").fields(count.count().alias("n"))).where("n > 1"))
simple("having_outer_query", "SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000", lambda db: Select(db, "t").with_("t", db.select("orders").group_by("o_custkey").fields(F.sum("o_totalprice").alias("total"))).where("total > 1000000"))

# -- order and paging
simple("order_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", lambda db: db.select("orders").fields("o_orderkey", "o_totalprice").order_by("o_totalprice").order_by("o_orderkey"))
simple("order_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", lambda db: db.select("orders").fields("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey"))
simple("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda db: db.select("orders").fields("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(10))
simple("start_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", lambda db: db.select("orders").fields("o_orderkey").order_by("o_orderkey").start(20).limit(10))
simple("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", lambda db: db.select("orders").fields("o_orderkey").limit(0))
simple("row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders", lambda db: numbering.dense(db.frame("orders").select("o_orderkey", "o_orderdate"), "k", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "k"))

# -- links and edges
ids = lambda db, name, key, kind: db.frame(name).withColumn("id", F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")))


class _Shown:
    """Tables made on demand, in front of a database."""

    def __init__(self, db: Files, **makers):
        self.db, self.makers = db, makers

    def frame(self, name: str) -> DataFrame:
        return self.makers[name]() if name in self.makers else self.db.frame(name)

    def table(self, name: str):
        return None


def _graph(db: Files) -> _Shown:
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return _Shown(
        db,
        customers=lambda: ids(db, "customer", "c_custkey", "customer").withColumn("nation", key("nation", "c_nationkey")),
        nations=lambda: ids(db, "nation", "n_nationkey", "nation"),
        orders_=lambda: ids(db, "orders", "o_orderkey", "order"),
        parts=lambda: ids(db, "part", "p_partkey", "part"),
        suppliers=lambda: ids(db, "supplier", "s_suppkey", "supplier"),
        placed=lambda: db.frame("orders").select(key("customer", "o_custkey").alias("in"), key("order", "o_orderkey").alias("out")),
        holds=lambda: db.frame("lineitem").select(key("order", "l_orderkey").alias("in"), key("part", "l_partkey").alias("out")),
    )


simple("fetch_link", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", lambda db: Select(_graph(db), "customers").fetch("nation", target="nations").df().select("c_custkey", "nation.n_name"))
simple("fetch_multi", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey", lambda db: graph.fetch(graph.fetch(db.frame("orders"), "o_custkey", db.frame("customer"), "c_custkey").select("o_orderkey", F.col("o_custkey.c_name").alias("c_name"), F.col("o_custkey.c_nationkey").alias("link")), "link", db.frame("nation"), "n_nationkey").select("o_orderkey", "c_name", "link.n_name"))
KEYS = "array_to_string(coalesce(list(o_orderkey ORDER BY 'order:' || o_orderkey) FILTER (o_orderkey IS NOT NULL), []), ',')"
simple("traverse_out", f"SELECT c_custkey, {KEYS} AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", lambda db: Select(_graph(db), "customers").out("placed", "orders_", "found").df().select("c_custkey", F.array_join(F.transform("found", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders")))
simple("traverse_in", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", lambda db: Select(_graph(db), "orders_").in_("placed", "customers", "by").df().select("o_orderkey", F.explode("by.c_name").alias("c_name")))
simple("traverse_multihop", "SELECT c_custkey, count(DISTINCT l_partkey) AS parts FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", lambda db: graph.path(_graph(db).frame("customers"), [(_graph(db).frame("placed"), "out"), (_graph(db).frame("holds"), "out")], _graph(db).frame("parts"), "parts").select("c_custkey", F.size("parts").cast("long").alias("parts")))


KINDS = ["customer", "order", "part", "supplier", "nation", "region"]


def _number(kind: str, c: str):
    """The id kind:c as a number: the traversal of all rows moves and sorts numbers, not strings."""
    return F.col(c).cast("long") * 8 + KINDS.index(kind)


def _multi_target(db: Files) -> DataFrame:
    """Parts and suppliers behind each order: ids are numbers, and of a target only whether it has a name is gathered."""
    number = lambda table, kind, c, *more: db.frame(table).select(_number(kind, c).alias("id"), *more)
    pair = lambda kind, c: db.frame("lineitem").select(_number("order", "l_orderkey").alias("in"), _number(kind, c).alias("out"))
    things = number("part", "part", "p_partkey", F.col("p_name").isNotNull().alias("part"), F.lit(False).alias("supplier"))
    things = things.unionByName(number("supplier", "supplier", "s_suppkey", F.lit(False).alias("part"), F.col("s_name").isNotNull().alias("supplier")))
    found = graph.step(number("orders", "order", "o_orderkey", "o_orderkey"), pair("part", "l_partkey").unionByName(pair("supplier", "l_suppkey")), things, "t")
    size = lambda test: F.size(F.filter("t", test)).cast("long")
    return found.select("o_orderkey", size(lambda x: x["part"]).alias("parts"), size(lambda x: x["supplier"]).alias("suppliers"))


simple("traverse_multi_target", "SELECT o_orderkey, count(l_partkey) AS parts, count(l_suppkey) AS suppliers FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", lambda db: _multi_target(db))
EDGES = "edges AS (SELECT DISTINCT l_suppkey AS a, (l_partkey % 90 + 1)::BIGINT AS b FROM lineitem WHERE l_linenumber = 7 AND l_suppkey <= 90)"
edges = lambda db: db.frame("lineitem").filter("l_linenumber = 7 and l_suppkey <= 90").select(F.col("l_suppkey").alias("in"), (F.col("l_partkey") % 90 + 1).alias("out"))
sources = lambda db: db.frame("supplier").filter("s_suppkey <= 5").select(F.col("s_suppkey").alias("id"))


def _depth_sql(least: int, most: int) -> str:
    return f"WITH RECURSIVE {EDGES}, walk AS (SELECT s_suppkey AS source, s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey <= 5 UNION SELECT source, b, depth + 1 FROM walk JOIN edges ON node = a WHERE depth < {most}) SELECT source, node, min(depth)::INT AS depth FROM walk GROUP BY 1, 2 HAVING min(depth) >= {least}"


simple("traverse_depth_bounded", _depth_sql(1, 3), lambda db: graph.reach(sources(db), edges(db), 1, 3, folder=shared.folder(db.spark)))


def _rounds(db: Files) -> str:
    return shared.folder(db.spark)


@query(_depth_sql(2, 40))
def traverse_depth_unbounded(db):
    return graph.reach(sources(db), edges(db), 2, None, folder=_rounds(db))


def _numbered(c: str):
    kind = F.col(c).bitwiseAND(7).cast("int")
    return F.concat(F.element_at(F.array(*map(F.lit, KINDS)), kind + 1), F.lit(":"), F.shiftright(c, 3).cast("string")).alias(c)


def links(db: Files) -> DataFrame:
    """Every link of the tables as an edge of numbered ids; orders point back to their customers, so there are cycles."""
    pair = lambda table, a, b: db.frame(table).select(_number(*a).alias("in"), _number(*b).alias("out"))
    customer, order = ("customer", "o_custkey"), ("order", "o_orderkey")
    found = pair("orders", customer, order).unionByName(pair("orders", order, customer))
    for target in (("part", "l_partkey"), ("supplier", "l_suppkey")):
        found = found.unionByName(pair("lineitem", ("order", "l_orderkey"), target))
    found = found.unionByName(pair("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")))
    return found.unionByName(pair("nation", ("nation", "n_nationkey"), ("region", "n_regionkey")))


def _reach_whole(db: Files, least: int, most: int | None) -> DataFrame:
    customers = db.frame("customer").select(_number("customer", "c_custkey").alias("id"))
    return graph.reach(customers, links(db), least, most, folder=_rounds(db)).select(_numbered("source"), _numbered("node"), "depth")


def _links_sql(depths: range) -> str:
    """Each kind of node has one depth in this graph, so no recursion is cut short."""
    kinds = (("order", "o_orderkey", 1), ("part", "l_partkey", 2), ("supplier", "l_suppkey", 2), ("nation", "s_nationkey", 3), ("region", "n_regionkey", 4))
    parts = (f"SELECT DISTINCT 'customer:' || c_custkey AS source, '{kind}:' || {c} AS node, {d} AS depth FROM walk WHERE {c} IS NOT NULL" for kind, c, d in kinds if d in depths)
    return "WITH walk AS (SELECT * FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey) " + " UNION ALL ".join(parts)


# all customers are sources, all rows of orders, lineitem, supplier and nation are edges
simple("traverse_depth_bounded_whole", _links_sql(range(1, 4)), lambda db: _reach_whole(db, 1, 3))
simple("traverse_depth_unbounded_whole", _links_sql(range(2, 5)), lambda db: _reach_whole(db, 2, None))


# -- aggregation
simple("group_count", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, avg(l_extendedprice) AS mean FROM lineitem WHERE l_quantity > 10 GROUP BY 1", lambda db: db.select("lineitem").where(lambda w: w.gt("l_quantity", 10)).group_by("l_returnflag").fields(count.count().alias("n"), F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("mean")))
simple("group_multi_key", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2", lambda db: db.select("lineitem").group_by("l_returnflag", "l_linestatus").fields("count(*) AS n"))
simple("group_distinct_keys", "SELECT DISTINCT o_orderstatus FROM orders", lambda db: db.select("orders").group_by("o_orderstatus"))
simple("agg_count_truthy", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS large, count(o_custkey) AS there FROM orders GROUP BY 1", lambda db: db.select("orders").group_by("o_orderstatus").fields(count.count(F.col("o_totalprice") > 100000).alias("large"), count.count("o_custkey").alias("there")))
for _name, _f, _sql in (
    ("sum", math.agg_sum, "round(sum(l_extendedprice), 2)"), ("mean", math.agg_mean, "round(avg(l_extendedprice), 2)"), ("min", math.agg_min, "round(min(l_extendedprice), 2)"), ("max", math.agg_max, "round(max(l_extendedprice), 2)"),
    ("median", math.agg_median, "round(median(l_extendedprice), 3)"), ("stddev", math.agg_stddev, "round(stddev_samp(l_extendedprice), 2)"), ("variance", math.agg_variance, "round(var_samp(l_extendedprice), 0)"),
):
    simple(f"agg_{_name}", f"SELECT l_returnflag, {_sql} AS v FROM lineitem GROUP BY 1", lambda db, f=_f, places={"variance": 0, "median": 3}.get(_name, 2): db.select("lineitem").group_by("l_returnflag").fields(F.round(f("l_extendedprice"), places).alias("v")))
simple("agg_product", "SELECT n_regionkey, product(n_nationkey + 1)::DOUBLE AS v FROM nation GROUP BY 1", lambda db: db.select("nation").group_by("n_regionkey").fields(F.product(F.col("n_nationkey") + 1).alias("v")))
simple("agg_global", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders", lambda db: db.select("orders").fields("count(*) AS n", "min(o_totalprice) AS low", "max(o_totalprice) AS high"))
simple("agg_collect_distinct", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1", lambda db: db.select("customer").group_by("c_nationkey").fields(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments")))
simple("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", lambda db: db.select("orders").group_by("o_orderstatus").fields(count.count_distinct("o_custkey").alias("n")))
simple("time_group_day", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", lambda db: db.frame("events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
simple("json_extract", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events", lambda db: db.select("events").fields("event_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k"))

# -- set operations
N = "SELECT n_regionkey AS k FROM nation"
R = "SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3"
nat = lambda db: db.select("nation").columns({"k": "n_regionkey"})
reg = lambda db: db.select("region").where("r_regionkey < 3").columns({"k": "r_regionkey"})
simple("union", f"{N} UNION {R}", lambda db: nat(db).union(reg(db)))
simple("union_all", f"{N} UNION ALL {R}", lambda db: nat(db).union_all(reg(db)))
simple("intersect", f"{N} INTERSECT {R}", lambda db: nat(db).intersect(reg(db)))
simple("except", f"{N} EXCEPT {R}", lambda db: nat(db).except_(reg(db)))
simple("setop_chain_left_assoc", f"(({N} UNION ALL {R}) INTERSECT {R}) UNION ALL {R}", lambda db: nat(db).union_all(reg(db)).intersect(reg(db)).union_all(reg(db)))
simple("setop_operand_limit", f"({N}) UNION ALL (SELECT r_regionkey AS k FROM region ORDER BY 1 DESC LIMIT 2)", lambda db: nat(db).union_all(db.select("region").columns({"k": "r_regionkey"}).order_by("k", "desc").limit(2)))

# -- search
PROBE = [((i * 37) % 64 - 32) / 32 for i in range(64)]
PSQL = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"
E = "embedding::DOUBLE[]"
for _name, _sql in (
    ("cosine", f"1 - list_cosine_similarity({E}, {PSQL})"), ("euclidean", f"list_distance({E}, {PSQL})"),
    ("manhattan", f"list_sum(list_transform(list_zip({E}, {PSQL}), lambda p: abs(p[1] - p[2])))"), ("minkowski", f"list_sum(list_transform(list_zip({E}, {PSQL}), lambda p: abs(p[1] - p[2]) ** 3)) ** (1 / 3)"),
):
    simple(f"knn_{_name}", f"SELECT vec_id, round({_sql}, 4) AS distance FROM embeddings ORDER BY {_sql}, vec_id LIMIT 5", lambda db, d=_name: search.nearest(db.frame("embeddings"), "embedding", PROBE, 5, d, tie="vec_id").select("vec_id", F.round("distance", 4).alias("distance")))
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
BM25 = f"""
WITH t AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents),
c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'der')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT id, round(ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)), 4) AS score
FROM c, s WHERE a > 0 OR b > 0"""
simple("bm25_match", BM25, lambda db: search.bm25(db.frame("documents"), "text", "the der", "doc_id").select("id", F.round("score", 4).alias("score")))

simple("bm25_index", BM25, lambda db: search.TextIndex.build(db.frame("documents"), "text", f"{shared.folder(db.spark)}/karst-text-{uuid.uuid4().hex}", "doc_id").search("the der").select("id", F.round("score", 4).alias("score")))
simple("filter_matches", f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['the', 'and'])", lambda db: db.select("documents").where(lambda w: w.build("text", "@1@", "The, and")).fields("doc_id"))
simple("knn_where", f"SELECT vec_id, round(1 - list_cosine_similarity({E}, {PSQL}), 4) AS distance FROM embeddings WHERE label = 3 ORDER BY 1 - list_cosine_similarity({E}, {PSQL}), vec_id LIMIT 5", lambda db: search.nearest(db.select("embeddings").where(lambda w: w.eq("label", 3)).df(), "embedding", PROBE, 5, tie="vec_id").select("vec_id", F.round("distance", 4).alias("distance")))
simple("knn_many", "SELECT query_id, id, round(d, 4) AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS k FROM embeddings q, embeddings e WHERE q.label = 2 AND e.label <> 2) WHERE k <= 3", lambda db: search.nearest_many(db.frame("embeddings").filter("label <> 2"), "embedding", db.frame("embeddings").filter("label = 2"), "embedding", 3, "euclidean", "vec_id", "vec_id").select("query_id", "id", F.round("distance", 4).alias("distance")))
simple("where_behind", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND p_size = 7)", lambda db: Select(_graph(db), "customers").where_behind([("placed", "out"), ("holds", "out")], "parts", lambda w: w.eq("p_size", 7)).fields("c_custkey"))
simple("agg_approx_distinct", "SELECT 1 AS near", lambda db: db.frame("orders").agg(count.approx_count_distinct("o_custkey", 0.01).alias("a"), count.count_distinct("o_custkey").alias("n")).select((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).cast("int").alias("near")))

# -- writes: the state after them
cust = lambda db: db.frame("customer").select("c_custkey", "c_name", "c_acctbal")
fresh = lambda db: cust(db).filter("c_custkey <= 20").select((F.col("c_custkey") * 10).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))
CU = "SELECT c_custkey, c_name, c_acctbal FROM customer"
FRESH = "SELECT c_custkey * 10 AS c_custkey, 'new ' || c_name AS c_name FROM customer WHERE c_custkey <= 20"
simple("insert_many", f"{CU} UNION ALL SELECT c_custkey, c_name, NULL FROM ({FRESH})", lambda db: mutate.insert(cust(db), fresh(db)))
simple("insert_ignore", f"{CU} UNION ALL SELECT c_custkey, c_name, NULL FROM ({FRESH}) f WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = f.c_custkey)", lambda db: mutate.insert_ignore(cust(db), fresh(db), "c_custkey"))
simple("create", f"{CU} UNION ALL SELECT -1 - c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 5", lambda db: mutate.create(cust(db), cust(db).filter("c_custkey < 5").withColumn("c_custkey", -1 - F.col("c_custkey")), "c_custkey"))
simple("insert_records", f"{CU} WHERE c_custkey NOT IN (SELECT c_custkey * 10 FROM customer) UNION ALL SELECT c_custkey * 10, 'new ' || c_name, NULL FROM customer", lambda db: mutate.records(cust(db), renewed(db), "c_custkey"))
# the same with rows written from all of customer
renewed = lambda db: cust(db).select((F.col("c_custkey") * 10).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"))
RENEWED = "SELECT c_custkey * 10 AS c_custkey, 'new ' || c_name AS c_name FROM customer"
simple("insert_many_whole", f"{CU} UNION ALL SELECT c_custkey, c_name, NULL FROM ({RENEWED})", lambda db: mutate.insert(cust(db), renewed(db)))
simple("insert_ignore_whole", f"{CU} UNION ALL SELECT c_custkey, c_name, NULL FROM ({RENEWED}) f WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = f.c_custkey)", lambda db: mutate.insert_ignore(cust(db), renewed(db), "c_custkey"))
simple("create_whole", f"{CU} UNION ALL SELECT -1 - c_custkey, c_name, c_acctbal FROM customer", lambda db: mutate.create(cust(db), cust(db).withColumn("c_custkey", -1 - F.col("c_custkey")), "c_custkey"))
simple("upsert_whole", f"SELECT coalesce(f.c_custkey, c.c_custkey) AS c_custkey, coalesce(f.c_name, c.c_name) AS c_name, c.c_acctbal FROM ({CU}) c FULL JOIN ({RENEWED}) f ON c.c_custkey = f.c_custkey", lambda db: mutate.upsert(cust(db), renewed(db), "c_custkey"))
simple("update_merge", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", lambda db: mutate.update(cust(db), {"c_acctbal": 0}, lambda w: w.lt("c_acctbal", 0)))
simple("update_replace", "SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'seven' ELSE c_name END AS c_name, CASE WHEN c_custkey = 7 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer", lambda db: mutate.replace(cust(db), {"c_name": "seven"}, lambda w: w.eq("c_custkey", 7), "c_custkey"))
simple("upsert", f"SELECT coalesce(f.c_custkey, c.c_custkey) AS c_custkey, coalesce(f.c_name, c.c_name) AS c_name, c.c_acctbal FROM ({CU}) c FULL JOIN ({FRESH}) f ON c.c_custkey = f.c_custkey", lambda db: mutate.upsert(cust(db), fresh(db), "c_custkey"))
simple("upsert_where", f"{CU} UNION ALL SELECT -1, 'nobody', NULL", lambda db: mutate.upsert_where(cust(db), lambda w: w.eq("c_name", "nobody"), {"c_name": "nobody"}, -1, "c_custkey"))
simple("delete_where", f"{CU} WHERE NOT c_acctbal < 0", lambda db: mutate.delete(cust(db), lambda w: w.lt("c_acctbal", 0)))
simple("delete_limit", f"{CU} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 ORDER BY 1 LIMIT 5)", lambda db: mutate.delete(cust(db), lambda w: w.lt("c_acctbal", 0), 5, "c_custkey"))
poor = lambda db: cust(db).filter("c_acctbal < 0")
IDS = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
simple("delete_cascade", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN {IDS}", lambda db: mutate.on_delete(db.frame("orders").select("o_orderkey", "o_custkey"), "o_custkey", poor(db), "cascade", "c_custkey"))
simple("delete_set_null", f"SELECT o_orderkey, CASE WHEN o_custkey NOT IN {IDS} THEN o_custkey END AS o_custkey FROM orders", lambda db: mutate.on_delete(db.frame("orders").select("o_orderkey", "o_custkey"), "o_custkey", poor(db), "set_null", "c_custkey"))
simple("relate", "SELECT 'customer:' || o_custkey AS \"in\", 'order:' || o_orderkey AS out, 5 AS rating FROM orders", lambda db: mutate.relate(_graph(db).frame("placed").limit(0).withColumn("id", F.lit("")).withColumn("rating", F.lit(0)), _graph(db).frame("placed"), {"rating": 5}).select("in", "out", "rating"))


def _log(db: Files) -> DataFrame:
    """events as a change log: each user is a row, an event is a change of it."""
    action = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return db.frame("events").select(F.col("event_id").alias("version"), action.alias("action"), F.col("user_id").cast("string").alias("id"), F.struct("user_id", "event_type", "value").alias("row"))


LAST = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events {}) WHERE k = 1 AND event_type <> 'error'"
simple("show_changes", "SELECT event_id AS version, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action, user_id::VARCHAR AS id FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 10", lambda db: _log(db).filter("version >= 100").orderBy("version").limit(10).select("version", "action", "id"))
simple("replay_now", LAST.format(""), lambda db: mutate.replay(_log(db)))
simple("version_read", LAST.format("WHERE event_id <= 300"), lambda db: mutate.replay(_log(db), 300))


def _streamed(db: Files, build) -> DataFrame:
    """What a live query over the change log delivers, once it has caught up."""
    import uuid

    from ..streaming.live import Live

    root = f"{shared.folder(db.spark)}/karst-live-{uuid.uuid4().hex}"
    log = _log(db)
    log.withColumn("version", F.col("version").cast("long")).write.parquet(f"{root}/log")
    live = build(Live(db.spark, f"{root}/log", log.schema["row"].dataType))
    live.start(lambda batch, k: batch.write.mode("append").parquet(f"{root}/out"), f"{root}/state", once=True).awaitTermination()
    return db.spark.read.parquet(f"{root}/out")


simple("live_fields_where", "SELECT event_id AS version, 'UPDATE' AS action, user_id, value FROM events WHERE event_type = 'purchase'", lambda db: _streamed(db, lambda x: x.where(lambda w: w.eq("event_type", "purchase")).fields("user_id", "value")))
simple("live_on_record", "SELECT event_id AS version, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action, event_type, value FROM events WHERE user_id = 3", lambda db: _streamed(db, lambda x: x.on_record("3").fields("event_type", "value")))
query(None, "live_diff")(lambda db: _streamed(db, lambda x: x.diff()))
simple("live_windows", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2", lambda db: db.frame("events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"))


# -- statements
# the names of SQL's types as Spark spells them
@query("""
SELECT column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS kind,
    true AS optional, '' AS links
FROM (DESCRIBE orders)
""")
def info_table(db):
    return db.info("orders")


@query(None)
def explain(db):
    text = db.select("orders").where(lambda w: w.gt("o_totalprice", 1000)).fields("o_orderkey").explain()
    return db.spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


# a new column that must have a value, and has no default, breaks the rows there are
@query("""
SELECT * FROM (VALUES
    ('drop_column', 'orders.o_orderstatus', 'ALTER TABLE `orders` DROP COLUMN `o_orderstatus`', true),
    ('drop_table', 'region', 'DROP TABLE `region`', true),
    ('add_column', 'orders.o_note', 'ALTER TABLE `orders` ADD COLUMN `o_note` string', true)) t(kind, name, sql, loses)
""")
def ddl_diff(db):
    from ..plans import ddl
    from ..schema import infer

    old = ddl.Model().add(infer("orders", db.frame("orders"))).add(infer("region", db.frame("region")))
    new = ddl.Model().add(infer("orders", db.frame("orders").drop("o_orderstatus").withColumn("o_note", F.lit(""))))
    return db.spark.createDataFrame([(c.kind, c.name, c.sql, c.loses) for c in ddl.diff(old, new)], "kind string, name string, sql string, loses boolean")



