"""Versions, cascades, order behind FETCH, search and bound tables."""

import pytest

from karst import schema as S
from karst.database import Database
from karst.operators import search
from karst.sources.store import Conflict, Store


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_two_writers(spark, tmp_path):
    """Of two writers that start from one version the second fails and loses nothing."""
    root = f"file://{tmp_path}/s"
    one, two = Store(spark, root), Store(spark, root)
    row = lambda *k: spark.createDataFrame([(f"t:{i}",) for i in k], "id string")
    one.define("t", row(0).schema)
    one.write("t", row(1))
    a, b = one.read("t"), two.read("t")
    one.write("t", a.unionByName(row(2)))
    with pytest.raises(Conflict):
        two.write("t", b.unionByName(row(3)))
    two.write("t", two.read("t").unionByName(row(3)))
    assert ids(one.read("t")) == ["t:1", "t:2", "t:3"] and one.versions("t") == [1, 2, 3]


def test_a_write_that_fails_frees_its_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.define("t", spark.createDataFrame([("",)], "id string").schema)
    with pytest.raises(Exception, match="no way"):
        store.write("t", spark.sql("select string(raise_error('no way')) as id"))
    store.write("t", spark.createDataFrame([("t:1",)], "id string"))
    assert ids(store.read("t")) == ["t:1"]


def test_snapshots(spark, tmp_path, monkeypatch):
    from karst.sources import store as module

    monkeypatch.setattr(module, "SNAPSHOT", 2)
    store = Store(spark, f"file://{tmp_path}/s")
    store.define("t", spark.createDataFrame([("", 1)], "id string, n int").schema)
    for k in range(1, 6):
        store.read("t")
        store.write("t", spark.createDataFrame([(f"t:{i}", k) for i in range(k)], "id string, n int"))
    assert [ids(store.read("t", k)) for k in (1, 3, 5)] == [[f"t:{i}" for i in range(k)] for k in (1, 3, 5)]
    assert {r["n"] for r in store.read("t").collect()} == {5} and store._versions(f"{store.root}/t/snapshot") == [2, 4]


def test_cascades_to_the_end(spark):
    """A chain of tables, links of a table to itself in a circle, and links that are cleared."""
    db = Database(spark)
    node = {"next": S.record("node", optional=True).deletes("cascade")}
    db.define(S.Table("node", node), spark.createDataFrame([(f"node:{i}", f"node:{i - 1}" if i > 1 else "node:4") for i in range(1, 7)] + [("node:9", None)], "id string, next string"))
    db.define(S.Table("leaf", {"of": S.record("node").deletes("cascade")}), spark.createDataFrame([("leaf:1", "node:6"), ("leaf:2", "node:9")], "id string, of string"))
    db.define(S.Table("note", {"on": S.record("leaf", optional=True).deletes("set_null")}), spark.createDataFrame([("note:1", "leaf:1"), ("note:2", "leaf:2")], "id string, on string"))
    db.delete("node:1")
    assert ids(db.frame("node")) == ["node:9"] and ids(db.frame("leaf")) == ["leaf:2"]
    assert {r["id"]: r["on"] for r in db.frame("note").collect()} == {"note:1": None, "note:2": "leaf:2"}


def test_order_survives_fetch(spark):
    db = Database(spark)
    db.define(S.Table("a", {"n": S.int_(), "to": S.record("b")}), spark.createDataFrame([(f"a:{i}", i * 7 % 50, f"b:{i % 5}") for i in range(50)], "id string, n long, to string"))
    db.define(S.Table("b", {"m": S.int_()}), spark.createDataFrame([(f"b:{i}", i) for i in range(5)], "id string, m long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = db.select("a").order_by("n", "desc").limit(20).fetch("to").df()
        assert [r["n"] for r in found.collect()] == list(range(49, 29, -1)) and found.columns == ["id", "n", "to"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_model(spark):
    db = Database(spark)
    users = db.model(db.define(S.Table("user", {"name": S.string(), "age": S.int_(optional=True)})))
    users.insert([{"id": "user:1", "name": "Alice", "age": 25}, {"id": "user:2", "name": "Bob"}])
    users.update({"age": 26}, "1")
    users.records([{"id": "user:1", "name": "Eve"}, {"id": "user:3", "name": "Dan"}])
    assert users.find("1") == {"id": "user:1", "name": "Eve", "age": None} and users.find("9") is None
    users.delete("2")
    assert ids(users.select().df()) == ["user:1", "user:3"] and db.bind_table("user") == users


def test_text_index_and_matches(spark, tmp_path):
    df = spark.createDataFrame([(1, "The cat and the dog"), (2, "a cat"), (3, None), (4, "dogs")], "id long, text string")
    index = search.TextIndex.build(df, "text", f"file://{tmp_path}/i")
    show = lambda x: sorted((r["id"], round(r["score"], 9)) for r in x.collect())
    for options in ({}, {"all_terms": True}):
        assert show(index.search("Cat dog", **options)) == show(search.bm25(df, "text", "Cat dog", **options))
    db = Database(spark)
    db.define(S.Table("t", {"text": S.string(optional=True)}), df.withColumn("id", df["id"].cast("string")))
    assert ids(db.select("t").where(lambda w: w.build("text", "@@", "dog THE")).df()) == ["1"]
    assert ids(db.select("t").where(lambda w: w.matches("text", "!")).df()) == []


def test_nearest_many_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_NUMBERS", 4)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(99, None), (98, [0.0, 0.0])], "id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(k, [float(k * 3), 1.0]) for k in range(5)], "id long, v array<double>")
    for distance in ("cosine", "euclidean"):
        found = search.nearest_many(df, "v", queries, "v", 2, distance)
        for k in range(5):
            alone = search.nearest(df.filter("id <> 98"), "v", [float(k * 3), 1.0], 2, distance).collect()
            got = found.filter(f"query_id = {k} and id <> 98").orderBy("distance", "id").collect()
            assert [round(r["distance"], 6) for r in got] == [round(r["distance"], 6) for r in alone][: len(got)] and got
    assert search.nearest_many(df, "v", queries.limit(0), "v", 2).collect() == []


def test_writes_of_stored_tables(spark, tmp_path):
    """Each verb records the rows that it touches; rows that a permission hides stay as they are."""
    db = Database(spark, f"file://{tmp_path}/s")
    db.define(S.Table("t", {"n": S.int_(optional=True), "open": S.bool_()}, permissions={"select": "open"}))
    row = lambda i, n, shown=True: {"id": f"t:{i}", "n": n, "open": shown}
    db.insert("t", [row(1, 1), row(2, 2), row(3, 3, False)])
    db.insert("t", [row(2, 20), row(4, 4)], ignore_duplicates=True)
    db.update("t", {"n": 10}, lambda w: w.gt("n", 1))
    db.upsert("t", [row(4, 40), row(5, 5)])
    db.records("t", [row(5, 50), row(6, 6)])
    db.replace("t:6", {"n": 60, "open": True})
    db.create("t", {"n": 7, "open": True}, "7")
    with pytest.raises(Exception, match="id exists"):
        db.create("t", {"n": 8, "open": True}, "3")
    db.upsert_where("t", lambda w: w.eq("n", 7), {"n": 70}, "t:8")
    db.upsert_where("t", lambda w: w.eq("n", 8), {"n": 8, "open": True}, "t:8")
    db.delete("t", limit=1)
    db.delete("t", lambda w: w.eq("n", 40))
    db.delete("t:3")
    found = {r["id"]: (r["n"], r["open"]) for r in db.store.read("t").collect()}
    assert found == {"t:2": (10, True), "t:3": (3, False), "t:5": (50, True), "t:6": (60, True), "t:7": (70, True), "t:8": (8, True)}
    assert ids(db.frame("t")) == ["t:2", "t:5", "t:6", "t:7", "t:8"]
    log = sorted((r["version"], r["action"], r["id"]) for r in db.store.log("t").collect())
    assert log == [
        (1, "CREATE", "t:1"), (1, "CREATE", "t:2"), (1, "CREATE", "t:3"), (2, "CREATE", "t:4"), (3, "UPDATE", "t:2"), (3, "UPDATE", "t:4"), (4, "CREATE", "t:5"), (4, "UPDATE", "t:4"),
        (5, "CREATE", "t:6"), (5, "UPDATE", "t:5"), (6, "UPDATE", "t:6"), (7, "CREATE", "t:7"), (8, "UPDATE", "t:7"), (9, "CREATE", "t:8"), (10, "DELETE", "t:1"), (11, "DELETE", "t:4"),
    ]
    with db:
        db.update("t", {"n": 0})
    assert {r["id"]: r["n"] for r in db.store.read("t").collect()} == {"t:2": 0, "t:3": 3, "t:5": 0, "t:6": 0, "t:7": 0, "t:8": 0}
