"""Bundles of functions: one query for about ten expressions over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import array as A
from ..functions import bytes_ as B

from ..functions import crypto as C
from ..functions import duration as D
from ..functions import encoding as E
from ..functions import geo as G
from ..functions import math as M
from ..functions import meta, negate, parse, rand, record, search, session
from ..functions import object_ as O
from ..functions import set_ as S
from ..functions import sql as Q
from ..functions import string as ST
from ..functions import time as TM
from ..functions import type_ as TY
from ..functions import value as V
from ..functions import vector as VE

#: name -> (table, prepared columns in Spark, the same in SQL, key columns, [(alias, column, SQL)])
BUNDLES: dict[str, tuple] = {}


def bundle(name: str, table: str, keys: list[str], items: list[tuple], spark_prep: dict | None = None, sql_prep: dict | None = None) -> None:
    BUNDLES[name] = (table, spark_prep or {}, sql_prep or {}, keys, items)


# arrays over the words of a name, as in "Customer#000000001" and "goldenrod lace spring"
WORDS = dict(spark_prep={"w": lambda: F.split("p_name", " "), "v": lambda: F.split(F.concat("p_type", F.lit(" "), "p_name"), " "), "n": lambda: F.array("p_size", F.col("p_size") + 1, F.lit(7), F.col("p_size"))}, sql_prep={"w": "string_split(p_name, ' ')", "v": "string_split(p_type || ' ' || p_name, ' ')", "n": "[p_size, p_size + 1, 7, p_size]"})
J = lambda c: A.join(c, "|")
L = "array_to_string({}, '|')".format
bundle("fn_array_1", "part", ["p_partkey"], [
    ("add_new", lambda: J(A.add("w", "zz")), L("CASE WHEN list_contains(w, 'zz') THEN w ELSE list_append(w, 'zz') END")),
    ("append", lambda: J(A.append("w", "zz")), L("list_append(w, 'zz')")),
    ("push", lambda: J(A.push("n", 9)), L("list_append(n, 9)")),
    ("concat", lambda: J(A.concat("w", "v")), L("list_concat(w, v)")),
    ("contains", lambda: A.contains("n", 7), "list_contains(n, 7)"),
    ("distinct", lambda: J(A.sort(A.distinct("n"))), L("list_sort(list_distinct(n))")),
    ("unique", lambda: J(A.sort(A.unique("w"))), L("list_sort(list_distinct(w))")),
    ("filter", lambda: J(A.filter("n", lambda e: e > 20)), L("list_filter(n, lambda e: e > 20)")),
    ("find", lambda: A.find("n", lambda e: e > 20), "list_filter(n, lambda e: e > 20)[1]"),
    ("first", lambda: A.first("w"), "w[1]"),
    ("last", lambda: A.last("w"), "w[-1]"),
    ("pop", lambda: A.pop("n"), "n[-1]"),
], **WORDS)
bundle("fn_array_2", "part", ["p_partkey"], [
    ("flatten", lambda: J(A.flatten(F.array("w", "v"))), L("flatten([w, v])")),
    ("grouped", lambda: J(A.sort(A.group(F.array("w", "v")))), L("list_sort(list_distinct(flatten([w, v])))")),
    ("intersect", lambda: J(A.sort(A.intersect("w", "v"))), L("list_sort(list_intersect(w, v))")),
    ("difference", lambda: J(A.sort(A.difference("w", "v"))), L("list_sort(list_distinct(list_concat(list_filter(w, lambda e: NOT list_contains(v, e)), list_filter(v, lambda e: NOT list_contains(w, e)))))")),
    ("is_empty", lambda: A.is_empty("w"), "len(w) = 0"),
    ("joined", lambda: A.join("n", ", "), "array_to_string(n, ', ')"),
    ("string_joined", lambda: A.string_join("w", "-"), "array_to_string(w, '-')"),
    ("length", lambda: A.length("v"), "len(v)::INT"),
    ("mapped", lambda: J(A.map("n", lambda e: e * 2)), L("list_transform(n, lambda e: e * 2)")),
    ("largest", lambda: A.max("n"), "list_max(n)"),
    ("smallest", lambda: A.min("n"), "list_min(n)"),
], **WORDS)
bundle("fn_array_3", "part", ["p_partkey"], [
    ("prepended", lambda: J(A.prepend("w", "zz")), L("list_prepend('zz', w)")),
    ("removed", lambda: J(A.remove("n", 1)), L("list_concat(n[1:1], n[3:])")),
    ("reversed", lambda: J(A.reverse("v")), L("list_reverse(v)")),
    ("sliced", lambda: J(A.slice("n", 1, 2)), L("n[2:3]")),
    ("sliced_rest", lambda: J(A.slice("n", 2)), L("n[3:]")),
    ("sorted", lambda: J(A.sort("n")), L("list_sort(n)")),
    ("sorted_desc", lambda: J(A.sort("n", "desc")), L("list_reverse_sort(n)")),
    ("total", lambda: A.sum("n"), "list_sum(n)::DOUBLE"),
    ("union_all_items", lambda: J(A.sort(A.union("w", "v"))), L("list_sort(list_distinct(list_concat(w, v)))")),
], **WORDS)
bundle("fn_set", "part", ["p_partkey"], [
    ("added", lambda: J(S.add("n", 9)), L("list_sort(list_distinct(list_append(n, 9)))")),
    ("difference", lambda: J(S.difference("w", "v")), L("list_sort(list_distinct(list_concat(list_filter(w, lambda e: NOT list_contains(v, e)), list_filter(v, lambda e: NOT list_contains(w, e)))))")),
    ("intersect", lambda: J(S.intersect("w", "v")), L("list_sort(list_intersect(w, v))")),
    ("is_empty", lambda: S.is_empty("n"), "len(n) = 0"),
    ("is_equal", lambda: S.is_equal("n", A.reverse("n")), "true"),
    ("length", lambda: S.length("n"), "len(list_distinct(n))::INT"),
    ("removed", lambda: J(S.remove("n", 7)), L("list_sort(list_distinct(list_filter(n, lambda e: e <> 7)))")),
    ("sorted", lambda: J(S.sort("w")), L("list_sort(list_distinct(w))")),
    ("together", lambda: J(S.union("w", "v")), L("list_sort(list_distinct(list_concat(w, v)))")),
], **WORDS)
bundle("fn_object", "customer", ["c_custkey"], [
    ("keys", lambda: J(A.sort(O.keys("m"))), "'key|nation'"),
    ("held", lambda: J(A.sort(O.values("m"))), "array_to_string(list_sort([c_custkey, c_nationkey::BIGINT]), '|')"),
    ("length", lambda: O.length("m"), "2"),
    ("is_empty", lambda: O.is_empty("m"), "false"),
    ("extended", lambda: O.extend("m", "m2")["nation"], "c_custkey * 2"),
    ("extended_len", lambda: O.length(O.extend("m", "m2")), "3"),
    ("left", lambda: J(O.keys(O.remove("m", "key"))), "'nation'"),
    ("round_trip", lambda: O.from_entries(O.entries("m"))["key"], "c_custkey"),
], spark_prep={"m": lambda: F.create_map(F.lit("key"), "c_custkey", F.lit("nation"), F.col("c_nationkey").cast("long")), "m2": lambda: F.create_map(F.lit("nation"), F.col("c_custkey") * 2, F.lit("more"), F.col("c_custkey"))})
bundle("fn_string_1", "part", ["p_partkey"], [
    ("concat", lambda: ST.concat("p_name", F.lit(" - "), "p_brand"), "p_name || ' - ' || p_brand"),
    ("contains", lambda: ST.contains("p_name", "re"), "contains(p_name, 're')"),
    ("ends", lambda: ST.ends_with("p_name", "e"), "ends_with(p_name, 'e')"),
    ("starts", lambda: ST.starts_with("p_name", "b"), "starts_with(p_name, 'b')"),
    ("joined", lambda: ST.join(F.split("p_name", " "), ","), "replace(p_name, ' ', ',')"),
    ("length", lambda: ST.length("p_name"), "length(p_name)::INT"),
    ("lowered", lambda: ST.lowercase("p_brand"), "lower(p_brand)"),
    ("raised", lambda: ST.uppercase("p_name"), "upper(p_name)"),
    ("matched", lambda: ST.matches("p_name", "[aeiou]{2}"), "regexp_matches(p_name, '[aeiou]{2}')"),
    ("repeated", lambda: ST.repeat("p_brand", 2), "repeat(p_brand, 2)"),
    ("replaced", lambda: ST.replace("p_name", "e", "3"), "replace(p_name, 'e', '3')"),
    ("reversed", lambda: ST.reverse("p_name"), "reverse(p_name)"),
])
bundle("fn_string_2", "part", ["p_partkey"], [
    ("sliced", lambda: ST.slice("p_name", 1, 4), "substr(p_name, 2, 3)"),
    ("sliced_rest", lambda: ST.slice("p_name", 3), "substr(p_name, 4)"),
    ("slug", lambda: ST.slug("p_type"), "trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-')"),
    ("parts", lambda: J(ST.split("p_type", " ")), "array_to_string(string_split(p_type, ' '), '|')"),
    ("substring", lambda: ST.substring("p_name", 2, 3), "substr(p_name, 3, 3)"),
    ("trimmed", lambda: ST.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))), "p_name"),
    ("words", lambda: A.length(ST.words("p_name")), "len(string_split(p_name, ' '))::INT"),
    ("wrapped", lambda: ST.wrap("p_brand", "*"), "'*' || p_brand || '*'"),
    ("distance", lambda: ST.distance("p_name", "p_type"), "levenshtein(p_name, p_type)::INT"),
    ("similarity", lambda: F.round(ST.similarity("p_name", "p_type"), 6), "round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6)"),
    ("encoded", lambda: ST.html_encode(F.concat(F.lit("<a href=\"x\">'&'"), "p_name")), "'&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;' || p_name"),
])
bundle("fn_string_is", "part", ["p_partkey"], [
    ("alphanum", lambda: ST.is_alphanum("p_brand"), "regexp_full_match(p_brand, '[\\p{L}\\p{N}]+')"),
    ("alpha", lambda: ST.is_alpha("p_name"), "regexp_full_match(p_name, '\\p{L}+')"),
    ("ascii", lambda: ST.is_ascii("p_name"), "true"),
    ("is_datetime", lambda: ST.is_datetime(F.lit("2024-01-15 10:30:00")), "true"),
    ("is_domain", lambda: ST.is_domain(F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(".example.com"))), "true"),
    ("email", lambda: ST.is_email(F.concat("p_brand", F.lit("@example.com"))), "regexp_full_match(p_brand || '@example.com', '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')"),
    ("hexadecimal", lambda: ST.is_hexadecimal(F.hex("p_partkey")), "true"),
    ("ipv4", lambda: ST.is_ipv4(F.concat(F.lit("10.0.0."), F.col("p_partkey").cast("string"))), "p_partkey <= 255"),
    ("ipv6", lambda: ST.is_ipv6(F.lit("::1")), "true"),
    ("ip", lambda: ST.is_ip(F.concat(F.lit("10.0.0."), F.col("p_partkey").cast("string"))), "p_partkey <= 255"),
    ("latitude", lambda: ST.is_latitude(F.col("p_partkey").cast("string")), "p_partkey <= 90"),
    ("longitude", lambda: ST.is_longitude(F.col("p_partkey").cast("string")), "p_partkey <= 180"),
    ("is_num", lambda: ST.is_numeric(F.col("p_size").cast("string")), "true"),
    ("semver", lambda: ST.is_semver(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0-rc.1"))), "true"),
    ("url", lambda: ST.is_url("p_name"), "false"),
    ("is_uuid", lambda: ST.is_uuid(C.uuid_v4()), "true"),
])
R = lambda c: F.round(c, 6)
bundle("fn_math_1", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("absolute", lambda: M.abs(F.col("l_discount") - 0.05), "abs(l_discount - 0.05)"),
    ("arc_cos", lambda: R(M.acos("l_discount")), "round(acos(l_discount), 6)"),
    ("arc_sin", lambda: R(M.asin("l_discount")), "round(asin(l_discount), 6)"),
    ("arc_tan", lambda: R(M.atan("l_quantity")), "round(atan(l_quantity), 6)"),
    ("arc_tan2", lambda: R(M.atan2("l_quantity", "l_tax")), "round(atan2(l_quantity, l_tax), 6)"),
    ("ceiling", lambda: M.ceil("l_extendedprice"), "ceil(l_extendedprice)::BIGINT"),
    ("cosine", lambda: R(M.cos("l_quantity")), "round(cos(l_quantity), 6)"),
    ("deg", lambda: R(M.deg("l_tax")), "round(degrees(l_tax), 6)"),
    ("power_e", lambda: R(M.exp("l_tax")), "round(exp(l_tax), 6)"),
    ("fixed", lambda: M.fixed("l_extendedprice", 1), "round(l_extendedprice, 1)"),
    ("floored", lambda: M.floor("l_extendedprice"), "floor(l_extendedprice)::BIGINT"),
])
bundle("fn_math_2", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("log_e", lambda: R(M.log("l_quantity")), "round(ln(l_quantity), 6)"),
    ("log_10", lambda: R(M.log10("l_quantity")), "round(log10(l_quantity), 6)"),
    ("log_2", lambda: R(M.log2("l_quantity")), "round(log2(l_quantity), 6)"),
    ("rad", lambda: R(M.rad("l_quantity")), "round(radians(l_quantity), 6)"),
    ("rounded", lambda: M.round("l_quantity"), "round(l_quantity)"),
    ("sine", lambda: R(M.sin("l_quantity")), "round(sin(l_quantity), 6)"),
    ("root", lambda: R(M.sqrt("l_quantity")), "round(sqrt(l_quantity), 6)"),
    ("tangent", lambda: R(M.tan("l_tax")), "round(tan(l_tax), 6)"),
    ("cut", lambda: M.trunc(-F.col("l_extendedprice")), "trunc(-l_extendedprice)::BIGINT"),
    ("powered", lambda: R(M.pow("l_quantity", 1.5)), "round(pow(l_quantity, 1.5), 6)"),
])
THREE = ("l_quantity", "l_extendedprice", "l_tax")
MEAN = "((l_quantity + l_extendedprice + l_tax) / 3)"
VAR = f"(((l_quantity - {MEAN}) ** 2 + (l_extendedprice - {MEAN}) ** 2 + (l_tax - {MEAN}) ** 2) / 2)"
bundle("fn_math_row", "lineitem", ["l_orderkey", "l_linenumber"], [
    ("row_sum", lambda: R(M.row_sum(*THREE)), "round(l_quantity + l_extendedprice + l_tax, 6)"),
    ("row_product", lambda: F.round(M.row_product(*THREE), 4), "round(l_quantity * l_extendedprice * l_tax, 4)"),
    ("row_min", lambda: M.row_min(*THREE), "least(l_quantity, l_extendedprice, l_tax)"),
    ("row_max", lambda: M.row_max(*THREE), "greatest(l_quantity, l_extendedprice, l_tax)"),
    ("row_mean", lambda: R(M.row_mean(*THREE)), f"round({MEAN}, 6)"),
    ("row_median", lambda: M.row_median(*THREE), "list_sort([l_quantity, l_extendedprice, l_tax])[2]"),
    ("row_variance", lambda: F.round(M.row_variance(*THREE), 2), f"round({VAR}, 2)"),
    ("row_stddev", lambda: F.round(M.row_stddev(*THREE), 4), f"round(sqrt({VAR}), 4)"),
])
EPOCH = "epoch_us(ts)"
bundle("fn_time_parts", "events", ["event_id"], [
    ("the_year", lambda: TM.year("ts"), "year(ts)::INT"),
    ("the_month", lambda: TM.month("ts"), "month(ts)::INT"),
    ("the_day", lambda: TM.day("ts"), "day(ts)::INT"),
    ("the_hour", lambda: TM.hour("ts"), "hour(ts)::INT"),
    ("the_minute", lambda: TM.minute("ts"), "minute(ts)::INT"),
    ("the_second", lambda: TM.second("ts"), "second(ts)::INT"),
    ("the_week", lambda: TM.week("ts"), "weekofyear(ts)::INT"),
    ("the_weekday", lambda: TM.weekday("ts"), "isodow(ts)::INT"),
    ("in_unix", lambda: TM.unix("ts"), f"{EPOCH} // 1000000"),
    ("in_millis", lambda: TM.millis("ts"), f"{EPOCH} // 1000"),
    ("in_micros", lambda: TM.micros("ts"), EPOCH),
    ("in_nanos", lambda: TM.nanos("ts"), f"{EPOCH} * 1000"),
])
ntz = lambda c: c.cast("timestamp_ntz")
bundle("fn_time_round", "events", ["event_id"], [
    ("floored", lambda: ntz(TM.floor("ts", "1h30m")), f"make_timestamp({EPOCH} - {EPOCH} % 5400000000)"),
    ("rounded", lambda: ntz(TM.round("ts", "1h")), f"make_timestamp(({EPOCH} + 1800000000) - ({EPOCH} + 1800000000) % 3600000000)"),
    ("grouped", lambda: ntz(TM.group("ts", "hour")), "date_trunc('hour', ts)::TIMESTAMP"),
    ("grouped_month", lambda: ntz(TM.group("ts", "month")), "date_trunc('month', ts)::TIMESTAMP"),
    ("formatted", lambda: TM.format("ts", "%Y-%m-%d %H:%M"), "strftime(ts, '%Y-%m-%d %H:%M')"),
])
bundle("fn_duration", "orders", ["o_orderkey"], [
    ("in_micros", lambda: D.micros("d"), "o_orderkey * 3661000000"),
    ("in_millis", lambda: D.millis("d"), "o_orderkey * 3661000"),
    ("in_secs", lambda: D.secs("d"), "o_orderkey * 3661"),
    ("in_mins", lambda: D.mins("d"), "o_orderkey * 3661 // 60"),
    ("in_hours", lambda: D.hours("d"), "o_orderkey * 3661 // 3600"),
    ("in_days", lambda: D.days("d"), "o_orderkey * 3661 // 86400"),
    ("in_weeks", lambda: D.weeks("d"), "o_orderkey * 3661 // 604800"),
    ("in_nanos", lambda: D.nanos("d"), "o_orderkey * 3661000000000"),
    ("below_max", lambda: F.col("d") < D.maximum(), "true"),
], spark_prep={"d": lambda: F.expr("o_orderkey * INTERVAL '3661' SECOND")})
bundle("fn_type_cast", "orders", ["o_orderkey"], [
    ("as_bool", lambda: TY.to_bool(F.lit("true")), "true"),
    ("as_datetime", lambda: ntz(TY.to_datetime(F.lit("2024-01-15T10:30:00Z"))), "TIMESTAMP '2024-01-15 10:30:00'"),
    ("as_decimal", lambda: TY.to_decimal(F.col("o_totalprice").cast("string")).cast("double"), "o_totalprice"),
    ("as_duration", lambda: D.secs(TY.to_duration(F.lit("1h30m"))), "5400::BIGINT"),
    ("as_float", lambda: TY.to_float(F.col("o_orderkey").cast("string")), "o_orderkey::DOUBLE"),
    ("as_int", lambda: TY.to_int(F.col("o_orderkey").cast("string")), "o_orderkey"),
    ("as_number", lambda: TY.to_number(F.lit("1.5")), "1.5::DOUBLE"),
    ("as_point", lambda: TY.point(F.lit(1), F.lit(2))["lat"], "2.0::DOUBLE"),
    ("as_string", lambda: TY.to_string("o_orderkey"), "o_orderkey::VARCHAR"),
    ("as_thing", lambda: TY.thing("orders", "o_orderkey"), "'orders:' || o_orderkey"),
    ("as_record", lambda: TY.record("orders", "o_orderkey"), "'orders:' || o_orderkey"),
    ("as_field", lambda: TY.field("o_orderstatus"), "o_orderstatus"),
])
bundle("fn_type_is", "orders", ["o_orderkey"], [
    ("array_is", lambda: TY.is_array(F.array("o_orderkey")), "true"),
    ("bool_is", lambda: TY.is_bool(F.col("o_orderkey") > 3), "true"),
    ("datetime_is", lambda: TY.is_datetime("o_orderdate"), "true"),
    ("decimal_is", lambda: TY.is_decimal("o_totalprice"), "false"),
    ("duration_is", lambda: TY.is_duration(F.expr("INTERVAL '1' DAY")), "true"),
    ("float_is", lambda: TY.is_float("o_totalprice"), "true"),
    ("int_is", lambda: TY.is_int("o_orderkey"), "true"),
    ("number_is", lambda: TY.is_number("o_orderstatus"), "false"),
    ("object_is", lambda: TY.is_object(F.struct("o_orderkey")), "true"),
    ("point_is", lambda: TY.is_point(TY.point(F.lit(1), F.lit(2))), "true"),
    ("record_is", lambda: TY.is_record("o_orderpriority"), "regexp_full_match(o_orderpriority, '\\w+:\\S+')"),
    ("string_is", lambda: TY.is_string("o_orderstatus"), "true"),
    ("negated", lambda: negate(F.col("o_orderkey") > 100), "NOT o_orderkey > 100"),
])
bundle("fn_value", "events", ["event_id"], [
    ("k", lambda: V.ints(F.variant_get("v", "$.k", "variant")), "(props ->> '$.k')::BIGINT"),
    ("number", lambda: V.numbers(F.variant_get("v", "$.k", "variant")), "(props ->> '$.k')::DOUBLE"),
    ("no_string", lambda: V.strings("v").isNull(), "true"),
    ("no_bool", lambda: V.booleans("v").isNull(), "true"),
    ("no_array", lambda: V.arrays("v").isNull(), "true"),
    ("an_object", lambda: V.objects("v").isNotNull(), "props IS NOT NULL"),
    ("no_float", lambda: V.floats(F.parse_json(F.lit("\"x\""))).isNull(), "true"),
    ("a_decimal", lambda: V.decimals(F.parse_json(F.lit("1.5"))).cast("double"), "1.5::DOUBLE"),
    ("no_datetime", lambda: V.datetimes("v").isNull(), "true"),
    ("no_point", lambda: V.points(F.parse_json(F.lit("3"))).isNull(), "true"),
    ("its_table", lambda: V.table(F.lit("user:1")), "'user'"),
    ("a_thing", lambda: V.thing(F.lit("user:1")), "'user:1'"),
], spark_prep={"v": lambda: F.parse_json("props")})
E64 = "embedding::DOUBLE[]"
bundle("fn_vector", "embeddings", ["vec_id"], [
    ("added", lambda: R(M.row_sum(VE.add("e", "u"))), "round(list_sum(e) + list_sum(u), 6)"),
    ("subtracted", lambda: R(M.row_sum(VE.subtract("e", "u"))), "round(list_sum(e) - list_sum(u), 6)"),
    ("scaled", lambda: R(M.row_sum(VE.multiply("e", 2.0))), "round(list_sum(e) * 2, 6)"),
    ("dotted", lambda: R(VE.dot("e", "u")), "round(list_dot_product(e, u), 6)"),
    ("size", lambda: R(VE.magnitude("e")), "round(sqrt(list_dot_product(e, e)), 6)"),
    ("unit", lambda: R(VE.magnitude(VE.normalize("e"))), "1.0::DOUBLE"),
    ("cosine", lambda: R(VE.similarity("e", "u")), "round(list_cosine_similarity(e, u), 6)"),
    ("angle", lambda: F.round(VE.angle("e", "u"), 5), "round(acos(greatest(-1, least(1, list_cosine_similarity(e, u)))), 5)"),
    ("distance", lambda: R(VE.distance("e", "u")), "round(list_distance(e, u), 6)"),
    ("crossed", lambda: R(VE.cross(F.slice("e", 1, 3), F.slice("u", 1, 3))[0]), "round(e[2] * u[3] - e[3] * u[2], 6)"),
], spark_prep={"e": lambda: F.col("embedding").cast("array<double>"), "u": lambda: F.reverse(F.col("embedding").cast("array<double>"))}, sql_prep={"e": E64, "u": f"list_reverse({E64})"})
P = lambda a, b: TY.point(F.lit(a), F.lit(b))
SQUARE = lambda: F.array(P(0, 0), P(40, 0), P(40, 40), P(0, 40))
bundle("fn_geo", "supplier", ["s_suppkey"], [
    ("metres", lambda: F.round(G.distance("p", P(0, 0)), 2), "round(2 * 6371008.8 * asin(sqrt(sin(radians(lat) / 2) ** 2 + cos(radians(lat)) * sin(radians(lng) / 2) ** 2)), 2)"),
    ("bearing", lambda: F.round(G.bearing(P(0, 0), "p"), 5), "round(degrees(atan2(sin(radians(lng)) * cos(radians(lat)), sin(radians(lat)))), 5)"),
    ("is_inside", lambda: G.within("p", SQUARE()), "lng < 40 AND lat < 40"),
    ("valid", lambda: G.is_valid("p"), "lat <= 90"),
    ("middle", lambda: G.centroid(SQUARE())["lng"], "20.0::DOUBLE"),
    ("area", lambda: F.round(G.area(SQUARE()) / 1e6, 0), "round(6371008.8 ** 2 * radians(40) * sin(radians(40)) / 1e6, 0)"),
    ("geohash", lambda: G.hash_encode(P(-5.6, 42.6), 5), "'ezs42'"),
    ("decoded", lambda: F.round(G.hash_decode(G.hash_encode("p", 12))["lng"], 4), "round(lng, 4)"),
], spark_prep={"p": lambda: F.struct((F.col("s_suppkey") % 80 + 0.25).cast("double").alias("lng"), (F.col("s_suppkey") % 70 + 0.5).cast("double").alias("lat"))}, sql_prep={"lng": "(s_suppkey % 80 + 0.25)::DOUBLE", "lat": "(s_suppkey % 70 + 0.5)::DOUBLE"})
bundle("fn_crypto", "customer", ["c_custkey"], [
    ("md", lambda: C.md5("c_name"), "md5(c_name)"),
    ("s1", lambda: C.sha1("c_name"), "sha1(c_name)"),
    ("s256", lambda: C.sha256("c_name"), "sha256(c_name)"),
    ("s512_len", lambda: ST.length(C.sha512("c_name")), "128"),
    ("blake_empty", lambda: C.blake3(F.lit("")), "'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262'"),
    ("one_at_a_time", lambda: C.joaat(F.lit("a")), "3392050242::BIGINT"),
    ("v4", lambda: ST.is_uuid(C.uuid_v4()), "true"),
    ("v7", lambda: ST.is_uuid(C.uuid_v7()), "true"),
])
bundle("fn_encoding_bytes", "customer", ["c_custkey"], [
    ("encoded", lambda: E.base64_encode("c_name"), "base64(c_name::BLOB)"),
    ("decoded", lambda: B.to_string(E.base64_decode(E.base64_encode("c_name"))), "c_name"),
    ("length", lambda: B.length("b"), "strlen(c_name)::INT"),
    ("resized", lambda: F.hex(B.resize("b", 4)), "hex(substr(c_name, 1, 4))"),
    ("reversed", lambda: B.to_string(B.reverse("b")), "reverse(c_name)"),
    ("xored", lambda: F.hex(B.xor("b", "b")), "repeat('00', strlen(c_name)::INT)"),
    ("anded", lambda: B.to_string(B.and_("b", "b")), "c_name"),
    ("ored", lambda: B.to_string(B.or_("b", "b")), "c_name"),
], spark_prep={"b": lambda: F.col("c_name").cast("binary")})
bundle("fn_parse", "customer", ["c_custkey"], [
    ("host_of", lambda: parse.email_host("mail"), "'example.com'"),
    ("user_of", lambda: parse.email_user("mail"), "'c' || c_custkey"),
    ("domain", lambda: parse.url_domain("url"), "'www.example.com'"),
    ("fragment", lambda: parse.url_fragment("url"), "'top'"),
    ("host", lambda: parse.url_host("url"), "'www.example.com'"),
    ("path", lambda: parse.url_path("url"), "'/a/' || c_custkey"),
    ("port", lambda: parse.url_port("url"), "8080"),
    ("query", lambda: parse.url_query("url"), "'k=' || c_custkey"),
    ("scheme", lambda: parse.url_scheme("url"), "'https'"),
    ("no_port", lambda: parse.url_port(F.lit("http://example.com/")), "NULL::INT"),
], spark_prep={"mail": lambda: F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")), "url": lambda: F.concat(F.lit("https://www.example.com:8080/a/"), F.col("c_custkey").cast("string"), F.lit("?k="), F.col("c_custkey").cast("string"), F.lit("#top"))})
bundle("fn_record_meta", "customer", ["c_custkey"], [
    ("id_part", lambda: record.id("r"), "c_custkey || ':x'"),
    ("table_part", lambda: record.table("r"), "'customer'"),
    ("meta_id", lambda: meta.id("r"), "c_custkey || ':x'"),
    ("meta_table", lambda: meta.table("r"), "'customer'"),
    ("meta_tb", lambda: meta.tb("r"), "'customer'"),
    ("marked", lambda: search.highlight(F.lit("Say hello, Hello"), "<b>", "</b>", "hello"), "'Say <b>hello</b>, <b>Hello</b>'"),
    ("from_text", lambda: Q.raw("c_custkey + 1"), "c_custkey + 1"),
    ("with_value", lambda: Q.expr("concat(c_name, :x)", x="it's"), "c_name || 'it''s'"),
], spark_prep={"r": lambda: F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"), F.lit(":x"))})
bundle("fn_random_and_session", "region", ["r_regionkey"], [
    ("r", lambda: rand.rand().between(0, 1), "true"),
    ("r_bool", lambda: rand.boolean().isNotNull(), "true"),
    ("r_enum", lambda: rand.enum("a", "b").isin("a", "b"), "true"),
    ("r_float", lambda: rand.floating(1, 2).between(1, 2), "true"),
    ("r_guid", lambda: ST.length(rand.guid()), "20"),
    ("r_int", lambda: rand.integer(1, 6).between(1, 6), "true"),
    ("r_string", lambda: ST.length(rand.string(10)), "10"),
    ("r_v4", lambda: ST.is_uuid(rand.uuid_v4()), "true"),
    ("r_v7", lambda: ST.is_uuid(rand.uuid_v7()), "true"),
    ("r_math", lambda: M.random().between(0, 1), "true"),
    ("shuffled", lambda: A.length(A.shuffle(F.array(F.lit(1), F.lit(2)))), "2"),
    ("now_is", lambda: TM.now().isNotNull(), "true"),
    ("user_is", lambda: session.user().isNotNull(), "true"),
    ("token_is", lambda: session.token().isNull(), "true"),
    ("zone_is", lambda: TM.timezone().isNotNull(), "true"),
])


def _query(name: str):
    table, prep, _, keys, items = BUNDLES[name]

    def run(spark, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        for c, make in prep.items():
            df = df.withColumn(c, make())
        return df.select(*keys, *(make().alias(a) for a, make, _ in items))

    return run


def _sql(name: str) -> str:
    table, _, prep, keys, items = BUNDLES[name]
    inner = f"(SELECT *{''.join(f', {s} AS {c}' for c, s in prep.items())} FROM {table}) AS t"
    return f"SELECT {', '.join(keys)}, {', '.join(f'{s} AS {a}' for a, _, s in items)} FROM {inner}"


QUERIES = {name: _query(name) for name in BUNDLES}
ORACLES = {name: _sql(name) for name in BUNDLES}

