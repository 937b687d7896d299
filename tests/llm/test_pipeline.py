"""The pipeline against brute force, stage by stage."""

import corpus_pipeline
import pytest
from test_dedup import brute_exact, brute_near
from test_text import check_packing

from karst.llm import langid, pseudonyms, scratch

DIR = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.fit(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not model.predict(r["text"])[2]]
    keep = {d for d, _, _, kept, _ in brute_exact(rows) if kept}
    rows = [r for r in rows if r[0] in keep]
    keep = {d for d, _, component in brute_near(rows) if d == component}
    rows = [r for r in rows if r[0] in keep]
    swapped = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in swapped.collect()]
    assert 100 < len(rows) < docs.count()
    check_packing([tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()], rows, 2048)


def test_only_the_last_table_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "folder", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, DIR).count() > 0
    assert [p.name.split("-")[2] for p in tmp_path.iterdir()] == ["packing"]


def test_packing_takes_anything(spark, messy, messy_df, empty_df):
    rows = [tuple(r) for r in corpus_pipeline.packing_stage(spark, messy_df, DIR).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    check_packing(rows, messy, 2048)
    assert corpus_pipeline.packing_stage(spark, empty_df, DIR).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stage_keeps_columns_and_takes_anything(spark, messy_df, empty_df, k):
    name, stage = corpus_pipeline.STAGES[k]
    for df in (messy_df, empty_df):
        out = stage(spark, df, DIR)
        assert out.columns == df.columns, name
        assert out.count() <= df.count()
