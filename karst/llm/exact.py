"""Operator 4: exact dedup over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z.  Every distinct text
becomes one index entry under the 64-bit hash of its normalised bytes:

* ``keys`` reads each text once and writes its hash, its SHA-256 and its id; from here on
  only these move, and texts again only where hashes collide.
* ``build_entries`` gathers the keys of equal texts; map-side aggregation shrinks
  hot groups before anything moves.  Unlike texts under one hash are entries of their
  own, chained under it.
* ``directory`` doubles, level by level, as long as a bucket of hash prefixes
  holds more than ``capacity`` entries with unlike hashes; each slot maps to the bucket at
  the shallowest depth that fits.  Entries of one hash can't be split and chain on.
* ``write_index`` looks up each entry's bucket; owner tasks write the buckets of their
  key range, in order, to the shared folder.
* ``exact_duplicates`` probes it: a row's hash gives its slot, the slot its bucket by the
  directory, and within the bucket the hash its entry.  Where entries are chained,
  the row's bytes are compared with each entry's.

Defined results: null text is empty text; texts may be of any length; all empty texts are one
group; a null doc_id gets a row, and stays only if its whole group has no doc_id; repeated
rows of one doc_id and text share one decision and both count in group_size; an
empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import as_text, documents, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries a bucket may hold before it splits.
CAPACITY = 50_000
#: Levels that the directory doubles by, before its buckets are looked at again.
STEP = 4


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; lower() does just that where all is ASCII, and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _key(normal: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(normal), 64 - key_bits)


def _slot(h: Column, depth: int, key_bits: int) -> Column:
    """The leading ``depth`` bits of a key."""
    return F.shiftrightunsigned(h, key_bits - depth)


def keys(docs: DataFrame, text: str = "text", id: str = "doc_id", key_bits: int = 64) -> DataFrame:
    """(id, h, sha) of every row, written."""
    normal = docs.select(F.col(id).alias("id"), ascii_lower(as_text(text)).alias("normal"))
    return stage(normal.select("id", _key(F.col("normal"), key_bits).alias("h"), F.unhex(F.sha2("normal", 256)).alias("sha")), "keys")


def build_entries(keys: DataFrame) -> DataFrame:
    """h, sha, keep_id, group_size, chain (entries under this hash) of each distinct text, written."""
    entries = stage(keys.groupBy("h", "sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "entries")
    chained = entries.groupBy("h").agg(F.count(F.lit(1)).alias("chain"))
    return entries.join(chained, "h")


def directory(entries: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """slot, depth, bucket: the directory once no bucket that can split is overfull; slots are prefixes of as many bits as the greatest depth."""
    depth = 0
    while True:
        slot = _slot(F.col("h"), depth, key_bits) if depth else F.lit(0).cast("long")
        slots = entries.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("held"), (F.min("h") != F.max("h")).alias("splits"))
        if depth >= key_bits or slots.filter((F.col("held") > capacity) & F.col("splits")).isEmpty():
            break
        depth = min(depth + STEP, key_bits)
    at = slots.select("slot", "held", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    at = at.withColumn("bucket", F.expr(f"shiftright(slot, {depth} - depth)"))
    fits = at.groupBy("depth", "bucket").agg(F.sum("held").alias("load"), F.collect_list("slot").alias("slots"))
    fits = fits.filter((F.col("load") <= capacity) | (F.col("depth") == depth))
    fits = fits.select(F.explode("slots").alias("slot"), F.struct("depth", "bucket").alias("at"))
    return fits.groupBy("slot").agg(F.min("at").alias("at")).select(F.lit(depth).alias("bits"), "slot", "at.depth", "at.bucket")


def in_buckets(rows: DataFrame, slots: DataFrame, key_bits: int = 64) -> DataFrame:
    """rows with the depth and bucket that the directory names for their hash."""
    bits = slots.select("bits").first()
    if bits is None:
        return rows.withColumn("depth", F.lit(0)).withColumn("bucket", F.lit(0).cast("long"))
    slot = _slot(F.col("h"), bits[0], key_bits) if bits[0] else F.lit(0).cast("long")
    return rows.withColumn("slot", slot).join(slots.drop("bits"), "slot").drop("slot")


def write_index(keys: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The index, with depth, bucket and the entry's columns, by one owner task for each range of keys; and its directory."""
    entries = build_entries(keys)
    slots = stage(directory(entries, capacity, key_bits), "directory")
    entries = in_buckets(entries, slots, key_bits)
    return stage(entries.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "index"), slots


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket of every row."""
    rows = keys(docs, text, id, key_bits)
    index, slots = write_index(rows, capacity, key_bits)
    rows = in_buckets(rows, slots, key_bits)
    probe = ["depth", "bucket", "h"]
    shown = ("id", "keep_id", "group_size", "sha", "bucket")
    found = rows.drop("sha").join(index.filter("chain = 1"), probe).select(*shown)
    chains = index.filter("chain > 1")
    if not chains.isEmpty():
        # texts of chained hashes only; each row's bytes against those of the entries under its hash
        texts = docs.select(F.col(id).alias("id"), ascii_lower(as_text(text)).alias("normal")).withColumn("h", _key(F.col("normal"), key_bits))
        texts = in_buckets(texts.join(chains.select("h").distinct(), "h", "left_semi"), slots, key_bits)
        held = chains.join(texts.select(*probe, F.col("id").alias("of"), F.col("normal").alias("held")), probe)
        held = held.filter(F.col("of").eqNullSafe(F.col("keep_id")) & (F.unhex(F.sha2("held", 256)) == F.col("sha"))).dropDuplicates(["h", "sha"])
        found = found.unionByName(texts.join(held, probe).filter(F.col("normal") == F.col("held")).select(*shown))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
