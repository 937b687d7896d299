"""Every registered query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from karst import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    found = df.collect()
    if name not in catalog.ORACLES:
        assert found
        return
    expected = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, found) == rows(expected.columns, expected.fetchall())
