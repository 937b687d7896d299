"""Rows that share a doc_id, or have none, are documents of their own."""

import random

import pytest
import xxhash
from test_dedup import brute_bytes, brute_words, tuples

from karst.llm import automata, row_keys, suffix_levels


@pytest.fixture(scope="module")
def same_ids():
    """Null and shared ids: long and short texts, repeated rows, the smallest long, ids beyond 2 ** 53."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(("red", "green", "blue", "dim")) for _ in range(n))
    said, own = words(40), [words(60) for _ in range(4)]
    rows = [(None, f"{own[0]} {said}"), (None, said), (None, "short"), (None, own[1]), (7, f"{said} {own[2]}"), (7, "x"), (7, f"y {own[2][:150]}"), (8, own[3]), (8, own[3]), (8, own[3])]
    rows += [(None, "z " * 90), (None, "z " * 90), (-(1 << 63), own[1]), ((1 << 62) + 1, own[0]), ((1 << 62) + 3, None), (9, words(30))]
    # in the order in which equal passages count
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))))
    return rows


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def in_order(rows):
    """brute_words sorts by id and puts null before -1 only: ranks instead, ids put back."""
    ids = sorted({r[0] for r in rows}, key=lambda d: (d is not None, d or 0))
    return ids, [(ids.index(d), t) for d, t in rows]


@pytest.mark.parametrize("crowd", [2, 512])
def test_bytes(spark, same_ids, crowd):
    df = spark.createDataFrame(same_ids, "doc_id long, text string").repartition(4)
    assert sorted(tuples(suffix_levels.remove_repeats(df, 40, 3, crowd=crowd)), key=str) == brute_bytes(same_ids, 40)


@pytest.mark.parametrize("crowd", [2, 512])
def test_words(spark, same_ids, crowd):
    df = spark.createDataFrame(same_ids, "doc_id long, text string").repartition(4)
    ids, ranked = in_order(same_ids)
    expected = sorted(((ids[r[0]], *r[1:]) for r in brute_words(ranked, 6)), key=str)
    assert sorted(tuples(automata.remove_repeats(df, 6, crowd=crowd)), key=str) == expected


def test_messy(messy, messy_df):
    """All rows, those with shared ids too."""
    assert sorted(tuples(suffix_levels.remove_repeats(messy_df, 20)), key=str) == brute_bytes(messy, 20)
    assert sorted(tuples(automata.remove_repeats(messy_df, 2)), key=str) == brute_words(messy, 2)


def test_keys(spark, same_ids):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(same_ids, "doc_id long, text string").repartition(4)
    found = row_keys.keyed(df, F.col("doc_id"), "key").orderBy("key").collect()
    assert len({r["key"] for r in found}) == len(same_ids)
    assert [(r["doc_id"], r["text"]) for r in found if r["text"]] == [r for r in same_ids if r[1]]
    alone = df.filter("doc_id is null or doc_id > 8").dropDuplicates(["doc_id"])
    assert {r["key"] for r in row_keys.keyed(alone, F.col("doc_id"), "key").collect()} == {row_keys.NO_ID, 9, (1 << 62) + 1, (1 << 62) + 3}
