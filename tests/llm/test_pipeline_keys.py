"""Copies go, also among rows that share a doc_id or have none."""

import corpus_pipeline
import pytest

WORDS = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("id", [None, 5])
def test_one_of_each_stays(spark, k, id):
    rows = [(id, WORDS), (id, WORDS), (id, "nothing like it at all"), (id, WORDS), (9, WORDS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = corpus_pipeline.STAGES[k][1](spark, df, "")
    assert sorted(r["text"] for r in found.collect()) == ["nothing like it at all", WORDS]
