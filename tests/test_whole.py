"""Graph and write queries that take all rows of their tables."""

import random

import pytest

from karst import catalog
from karst.operators import graph

DIR = "/root/testdata/sf0.001"


def brute_reach(sources, edges, least, most):
    out = set()
    for s in sources:
        at, depth, new = {s: 0}, 0, [s]
        while new and (most is None or depth < most):
            depth += 1
            new = sorted({b for a, b in edges if a in new} - set(at))
            at |= {n: depth for n in new}
        out |= {(s, n, d) for n, d in at.items() if d >= least}
    return sorted(out)


@pytest.mark.parametrize("least,most", [(0, 0), (1, 3), (2, None), (0, None)])
def test_reach_against_brute_force(spark, least, most):
    """Cycles, loops, parallel edges, a long chain and sources without edges."""
    rng = random.Random(7)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(35)] + [(3, 3), (3, 4), (3, 4)] + [(i, i + 1) for i in range(100, 108)]
    sources = [0, 3, 5, 9, 100, 500]
    found = graph.reach(spark.createDataFrame([(s,) for s in sources], "id long"), spark.createDataFrame(edges, "in long, out long"), least, most)
    assert sorted(tuple(r) for r in found.collect()) == brute_reach(sources, edges, least, most)


def test_traversals_take_every_row(spark):
    found = catalog.QUERIES["traverse_depth_bounded_whole"](spark, DIR).collect()
    orders = spark.read.parquet(f"{DIR}/orders.parquet").collect()
    assert {r["source"] for r in found} == {f"customer:{r['o_custkey']}" for r in orders}
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").collect()
    expected = {f"{kind}:{r[c]}" for rows, kind, c in ((orders, "order", "o_orderkey"), (lines, "part", "l_partkey"), (lines, "supplier", "l_suppkey")) for r in rows}
    assert expected <= {r["node"] for r in found}


@pytest.mark.parametrize("name", ["insert_many_whole", "create_whole"])
def test_writes_take_every_row(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() == 2 * spark.read.parquet(f"{DIR}/customer.parquet").count()
