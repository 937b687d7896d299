"""Operator 2: SimHash near-dedup with deletion-variant signatures.

The fingerprint of a text has a bit set where over half of its shingles' hashes
have it; fingerprints link when they differ in at most ``max_bits`` bits.

Cut into floor(max_bits / 2) + 1 segments, two linked fingerprints must differ by
at most one bit in some segment.  Every distinct fingerprint is indexed under
each of its segments with each bit in turn replaced by a wildcard: two segments
within one bit of each other share such a variant.  Equal variants are brought
together by one shuffle, sorted, and verified against all 64 bits.

Groups of copies cost little: equal fingerprints are one node.  Variants with
more than ``crowd`` members are not compared pair by pair, as that grows with
the square; their members are linked exactly in another way (``crowded_links``):
fingerprints within 2b bits are those that share a neighbour within b bits, so
all neighbours within max_bits / 2 bits are written out and each one's owners
tied to the smallest.

A fingerprint that more than a thousandth of all rows have is one of at most a thousand: the
components of these are broadcast to the rows, those of all others shuffled to them.

Defined results: null or wordless texts have fingerprint 0, linked like any
other; texts may be of any length; texts shorter than a shingle hash whole; repeated rows get equal rows;
rows without a doc_id get a fingerprint and the component of that; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import collapse, connected_components
from .scratch import as_text, documents, stage

WORDS_IN_SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members of one variant that are compared pair by pair.
CROWD = 4096
#: Fingerprints that may each have more than their share of all rows.
MOST_OFTEN = 1000
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = WORDS_IN_SHINGLE) -> int:
    """64-bit SimHash over word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and \x20 \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - width + 1, 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist() if len(words) >= width else [len(joined)]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = np.array([fingerprint(t) for t in x["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": x["id"], "fp": found.view(np.int64)})

    return docs.select(F.col(id).cast("long").alias("id"), as_text(text).alias("text")).mapInPandas(run, "doc_id long, fp long")


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment: the fewest of which one differs in at most one bit."""
    n = max_bits // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def variants(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, fp): for every segment and every bit of it the segment without that bit, tagged by both."""
    keys = []
    for k, (low, size) in enumerate(segments(max_bits)):
        part = F.shiftrightunsigned("fp", low).bitwiseAND((1 << size) - 1)
        keys += [part.bitwiseAND(~(1 << bit)).bitwiseOR((k * 64 + bit) << 48) for bit in range(size)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def verified_links(pairs: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(a, b, crowded) from (key, fp): a spanning set of the links among each key's fingerprints.

    A key with more than ``crowd`` members gives its members as loops marked crowded.
    """

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(key)))
        group, size = np.cumsum(fresh) - 1, np.repeat(sizes, sizes)
        many = size > crowd
        if many.any():
            own = np.unique(fp[many])
            yield pd.DataFrame({"a": own, "b": own, "crowded": True})
        left, right = [], []
        for step in range(1, int(sizes[sizes <= crowd].max(initial=1))):
            i = np.flatnonzero((size[:-step] > step) & ~many[:-step] & (group[:-step] == group[step:]))
            if not len(i):
                break
            i = i[np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= max_bits]
            left.append(fp[i])
            right.append(fp[i + step])
        if left and sum(map(len, left)):
            node, root = collapse(np.concatenate(left), np.concatenate(right))  # across keys too: links stay links
            keep = node != root
            yield pd.DataFrame({"a": node[keep], "b": root[keep], "crowded": False})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by key; the last key of a batch waits for the next batch, but never more than a crowd of it
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for x in batches:
            key, fp = np.concatenate((key, x["key"].to_numpy())), np.concatenate((fp, x["fp"].to_numpy()))
            if over is not None:
                same = key == over
                if same.any():
                    own = np.unique(fp[same])
                    yield pd.DataFrame({"a": own, "b": own, "crowded": True})
                key, fp = key[~same], fp[~same]
                if not len(key):
                    continue
                over = None
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from links(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
            if len(key) > crowd:
                over = key[0]
                yield from links(key, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from links(key, fp)

    return pairs.mapInPandas(run, "a long, b long, crowded boolean")


def crowded_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): the same links among these fingerprints, in proportion to their number and not to its square."""
    masks = [sum(1 << b for b in c) for n in range(max_bits // 2 + 1) for c in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    near = prints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("at"), "fp")
    low = near.groupBy("at").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return near.join(low, "at").select(F.col("fp").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    if max_bits < 2 or max_bits % 2:
        raise ValueError("max_bits must be even and at least 2")
    rows = stage(fingerprints(docs, text, id), "prints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = variants(nodes.select("fp").repartition(tasks), max_bits).repartition("key").sortWithinPartitions("key")
    found = stage(verified_links(found, max_bits, crowd), "links")
    links = found.filter("not crowded").select("a", "b")
    crowd_members = found.filter("crowded").select(F.col("a").alias("fp")).distinct()
    if not crowd_members.isEmpty():
        links = links.unionByName(crowded_links(crowd_members, max_bits))
    linked = connected_components(links)
    named = linked.join(nodes.withColumnRenamed("fp", "node"), "node", "left")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    named = stage(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "named")
    often = F.col("n") > rows.count() / MOST_OFTEN
    hot = F.broadcast(named.filter(often).select("fp", "component_id"))
    told = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(named.filter(~often).select("fp", "component_id"), "fp"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
