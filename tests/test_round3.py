"""Findings of round 2: large durations, many nearest neighbours, traversals and the text index at size."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from karst import catalog
from karst.operators import graph, search

from test_whole import DIR, brute_reach


def test_durations_beyond_nanos(spark, tmp_path):
    """One order whose nanos exceed a long does not fail the others."""
    keys = [1, 2_519_358, 2_519_359, 9_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["o_orderkey"]: r for r in catalog.QUERIES["fn_duration"](spark, str(tmp_path)).collect()}
    assert [found[k]["in_nanos"] for k in keys] == [k * 3_661_000_000_000 if k < 2_519_359 else None for k in keys]
    assert [found[k]["in_micros"] for k in keys] == [k * 3_661_000_000 for k in keys]
    assert [found[k]["in_weeks"] for k in keys] == [k * 3661 // 604800 for k in keys]


def test_times_beyond_nanos(spark):
    from karst.functions import time

    rows = spark.sql("select timestamp'2024-01-15 00:00:00' as t union all select timestamp'9999-01-01 00:00:00'")
    assert [r[0] for r in rows.orderBy("t").select(time.nanos(F.col("t"))).collect()] == [1_705_276_800_000_000_000, None]


def test_nearest_many_holds_few_scores(monkeypatch):
    """Scores are held in parts, copies tie by their ids, whatever the batch they came in."""
    rng = np.random.default_rng(3)
    m = np.concatenate((rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(3, 16)) * 1e3, 100, axis=0)))
    ids, q = rng.permutation(len(m)), np.concatenate((m[[0, 299, 300, 599]], rng.normal(size=(40, 16))))
    largest = []
    real = np.nonzero
    monkeypatch.setattr(search.np, "nonzero", lambda x: largest.append(x.size if x.ndim == 2 else 0) or real(x))
    monkeypatch.setattr(search, "SCORES", 512)
    for distance in ("euclidean", "cosine"):
        d = np.stack([search._distances(np.repeat(v[None], len(m), axis=0), m, distance) for v in q])
        expected = [(i, ids[j]) for i in range(len(q)) for j in np.lexsort((ids, d[i]))[:5]]
        for size in (600, 7, 150):
            found = search._nearest_in(((ids[i : i + size], m[i : i + size]) for i in range(0, len(m), size)), q, 5, distance)
            assert list(zip(found["query"], found["id"])) == expected
    assert max(largest) <= 512


def test_nearest_many_ties_of_copies(spark):
    """Copies far from the origin: their distances are the same number, so the smallest ids are nearest."""
    v = [1000.1 + i for i in range(64)]
    df = spark.createDataFrame([(f"v{i:03}", v if i % 2 else [x + i + 1 for x in v]) for i in range(200)], "id string, v array<float>").repartition(7)
    found = search.nearest_many(df, "v", df.filter("id in ('v101', 'v150')"), "v", 3, "euclidean")
    got = sorted(((r["query_id"], r["distance"], r["id"]) for r in found.collect()))
    assert got[:3] == [("v101", 0.0, "v001"), ("v101", 0.0, "v003"), ("v101", 0.0, "v005")]
    assert got[3][1:] == (0.0, "v150")


def test_reach_follows_few_nodes(spark, monkeypatch):
    """With and without broadcast edges, of strings and of numbers; a round of which no node leads on is the last."""
    rng = random.Random(11)
    edges = [(rng.randrange(60), rng.randrange(80)) for _ in range(90)] + [(i, i + 1) for i in range(100, 106)] + [(5, 5), (5, 7), (5, 7)]
    sources = [0, 5, 9, 100, 103, 999]
    for few, kind, least, most in ((0, "string", 0, None), (3, "long", 0, None), (500_000, "string", 1, 3)):
        monkeypatch.setattr(graph, "FEW", few)
        found = graph.reach(spark.createDataFrame([(s,) for s in sources], "id long").select(F.col("id").cast(kind)), spark.createDataFrame(edges, "in long, out long").select(F.col("in").cast(kind), F.col("out").cast(kind)), least, most)
        assert found.columns == ["source", "node", "depth"]
        assert sorted((int(r[0]), int(r[1]), r[2]) for r in found.collect()) == brute_reach(sources, edges, least, most)


def test_reach_ends_where_nothing_leads_on(spark, tmp_path):
    """Sources, edges and two rounds are written; the ends of the second lead nowhere, so there is no third."""
    edges = [(0, 10 + i) for i in range(5)] + [(10 + i, 100 + i) for i in range(5)]
    graph.reach(spark.createDataFrame([(0,)], "id long"), spark.createDataFrame(edges, "in long, out long"), 1, None, folder=f"file://{tmp_path}").collect()
    depths = [spark.read.parquet(str(p)) for p in tmp_path.glob("karst-reach-*")]
    assert max(d.agg(F.max("depth")).first()[0] for d in depths if "depth" in d.columns) == 2
    assert sum("depth" in d.columns for d in depths) == 3


def test_text_index_cuts_each_text_once(spark, tmp_path, monkeypatch):
    """Postings are counted in their rows; the statistics come from them, also for texts without words."""
    df = spark.createDataFrame([(1, "the cat The dog"), (2, "a cat"), (3, None), (4, ""), (5, "..."), (6, "the " * 50)], "id long, text string").repartition(3)
    cut = spark.sparkContext.accumulator(0)

    def once(text):
        cut.add(1)
        return text

    index = search.TextIndex.build(df.withColumn("text", F.udf(once)("text")), "text", f"file://{tmp_path}/i")
    assert cut.value == 6
    found = spark.read.parquet(f"{index.path}/postings").filter("term is not null")
    assert sorted((r["term"], r["id"], r["n"], r["tf"]) for r in found.collect()) == [("a", 2, 2, 1), ("cat", 1, 4, 1), ("cat", 2, 2, 1), ("dog", 1, 4, 1), ("the", 1, 4, 2), ("the", 6, 50, 50)]
    assert spark.read.parquet(f"{index.path}/totals").first()["docs"] == 6
    show = lambda x: sorted((r["id"], round(r["score"], 9)) for r in x.collect())
    assert show(index.search("the cat")) == show(search.bm25(df, "text", "the cat"))


def test_multi_target_gathers_no_names(spark):
    """Every order, with the targets of its lines; names of targets stay where they are."""
    df = catalog.QUERIES["traverse_multi_target"](spark, DIR)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "p_name, p_name#" not in plan
    lines = Counter(r["l_orderkey"] for r in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey").collect())
    orders = [r["o_orderkey"] for r in spark.read.parquet(f"{DIR}/orders.parquet").collect()]
    assert sorted(tuple(r) for r in df.collect()) == sorted((k, lines[k], lines[k]) for k in orders)
