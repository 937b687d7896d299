"""From raw documents to packed sequences, stage by stage.

Each stage is given what its predecessor kept and calls one operator over all of
it; what it decides takes effect in what it returns.  All stages but the last
return the columns of their input.  A stage's result is written as Parquet and
read again, so a lost executor costs no more than the stage at hand.  Tables that a
stage needed on its way, and its predecessor's, are deleted once it is written.

Defined results, of every stage: null text counts as empty, and has no language; texts may be of any
length; rows that share a doc_id, or have none, are told apart by a key of their own; of repeated
rows one stays behind exact dedup, the last in order of that key; ties between languages go to the first by
name; an empty table gives an empty table; further columns stay as they are, and the last stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import exact, langid, packing, pseudonyms, row_keys, scratch, simhash


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with column _key: a key of each row, also where doc_ids are missing or shared."""
    return row_keys.keyed(docs, F.col("doc_id").cast("long"), "_key")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose _key is among kept's doc_ids, without it."""
    return rows.join(kept.select(F.col("doc_id").alias("_kept")), F.col("_key") == F.col("_kept"), "left_semi").drop("_key")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the identifier rejects: those without letters, and unsure ones."""
    return langid.accepted(docs, langid.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    rows = _keyed(docs)
    return _only(rows, exact.exact_duplicates(rows, id="_key").filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id stays."""
    rows = _keyed(docs)
    return _only(rows, simhash.near_duplicates(rows, id="_key").filter("doc_id = component_id"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of the same format; n_chars follows the text."""
    changed = pseudonyms.pseudonymise(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_pii") > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all that is left in sequences."""
    return packing.op3_best_fit_packing(spark, sf_dir, docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained predictions, fingerprints and token ids have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = scratch.documents(spark, sf_dir), []
    for name, stage in STAGES:
        with scratch.temporary(spark) as made:
            docs = scratch.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept = made.pop()  # the stage's own table is the last
            made += held
            held = [kept]
    return docs
