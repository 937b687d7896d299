"""Operator 6: long repeated byte strings, by a logarithmic family of suffix arrays.

Suffixes are sampled: a document's sampled suffixes start at its anchors, chosen
so that no ``PASSAGE`` bytes in a row are without one (see ``zones``).  A level is an
array of the sampled suffixes of some batches: suffixes that start alike stand together,
by the hash of their first bytes (``head``), and copies next to each other, by the digest of their zone.

``SuffixLevels`` takes documents in batches.  A new batch gets its array; it is merged,
in one pass, with the levels 0, 1, ... up to the first free rank, where the merged array
goes, and scanned against the levels that stay.  Suffixes that a scan finds next to one
with the same head are handed on; nothing else is compared, so the result rests on
the scans.  After any number of batches there are at most a logarithm of levels, and each
suffix has been merged as often at most.

What has been handed on is put in the order of its bytes, head by head (``suffix_array``), once
forwards from the anchor and once backwards.  The common length of neighbours (``lcp``) gives that
of any two, and what two have in common on both sides of their anchors is a match: equal byte by byte.

Results speak of two lengths.  Bytes covered by a repeated string of ``LENGTH`` bytes are
removed.  ``n_repeated`` counts those covered by a repeated string of ``PASSAGE`` bytes, a
passage of some 50 words, which may be too short to be removed.

Defined results: null text is empty text; texts may be of any length; strings shorter than
``length`` are never removed; a match may overlap itself; rows that share a doc_id are
documents of their own, rows without one too; repeated rows remove each other; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats, zones
from .repeats import KEYS, Units, by_bytes, hot_heads, partial, scan, spans, texts
from .scratch import documents, drop, stage

LENGTH = 400
#: The shorter length, of which repeats are counted only.
PASSAGE = 256
#: Batches that a whole corpus is taken in.
BATCHES = 4


class SuffixLevels:
    """The family: levels[rank] is the array of 2 ** rank batches or None."""

    def __init__(self, units: Units, hot: list[int] = ()):
        self.units, self.hot = units, hot
        self.levels: list[DataFrame | None] = []
        self.matched: list[DataFrame] = []

    @staticmethod
    def merged(arrays: list[DataFrame]) -> DataFrame:
        """Arrays in one, with column met: whether a suffix shares its head with another, one of them fresh."""
        rows = arrays[0]
        for more in arrays[1:]:
            rows = rows.unionByName(more)
        near = Window.partitionBy("head", "salt")
        rows = rows.repartition("head", "salt").withColumn("met", F.max("fresh").over(near) & ((F.count(F.lit(1)).over(near) > 1) | (F.col("salt") > 0)))
        return rows.sortWithinPartitions(*KEYS)

    def add(self, rows: DataFrame) -> None:
        """Indexes a batch of (doc, text)."""
        rank = next((r for r, level in enumerate(self.levels) if level is None), len(self.levels))
        below, above = self.levels[:rank], [level for level in self.levels[rank:] if level is not None]
        columns = [*KEYS, "more"]
        new = partial(rows, self.units, self.hot).withColumn("fresh", F.lit(True))
        array = stage(self.merged([new, *(level.select(*columns, F.lit(False).alias("fresh")) for level in below)]), "level")
        self.matched.append(stage(array.filter("met or more is not null").select(*columns), "matched"))
        for level in below:
            drop(level)
        for level in above:
            both = self.merged([array.filter("fresh").select(*columns, "fresh"), level.select(*columns, F.lit(False).alias("fresh"))])
            self.matched.append(stage(both.filter("met").select(*columns), "matched"))
        self.levels += [None] * (rank + 1 - len(self.levels))
        self.levels[:rank] = [None] * rank
        self.levels[rank] = array

    def met(self) -> DataFrame:
        """The suffixes that any scan has handed on, each once."""
        found = self.matched[0]
        for more in self.matched[1:]:
            found = found.unionByName(more)
        return found.dropDuplicates(["doc", "spot"])


def suffix_array(parts: list[bytes], heads: list[int]) -> np.ndarray:
    """The order of suffixes: by head, then by their bytes."""
    return np.array(sorted(range(len(parts)), key=lambda i: (heads[i], parts[i])), dtype=np.int64)


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    width = int(sizes.max(initial=0)) + 1
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(-1, width), sizes


def lcp(matrix: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many first bytes two suffixes have in common, for each pair of rows."""
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        unlike = matrix[a] != matrix[b]
        unlike[:, -1] = True
        out[at : at + len(a)] = np.minimum(np.minimum(sizes[a], sizes[b]), unlike.argmax(axis=1))
    return out


def _neighbours(order: np.ndarray, near: np.ndarray, heads: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one head with at least so much in common, and how much, step by step through an array; near: lcp of neighbours."""
    common = np.where(heads[order][1:] == heads[order][:-1], near, 0)
    at = np.flatnonzero(common >= least)
    have, step = common[at], 1
    while len(at):
        yield order[at], order[at + step], have
        on = at + step < len(common)
        at, have = at[on], np.minimum(have[on], common[at[on] + step])
        at, have, step = at[have >= least], have[have >= least], step + 1


def common_strings(units: Units):
    """(doc, start, end) of what each stretch has in common with another of its head, around their anchors, of at least ``length`` bytes."""
    half = units.length // 2

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        lead, heads = x["lead"].to_numpy(), x["head"].to_numpy()
        own = heads.tolist()
        forth = [d[k:] for d, k in zip(x["data"], lead.tolist())]
        back = [d[:k][::-1] for d, k in zip(x["data"], lead.tolist())]
        (f, f_sizes), (b, b_sizes) = _matrix(forth), _matrix(back)
        found = []
        order = suffix_array(forth, own)
        for i, j, right in _neighbours(order, lcp(f, f_sizes, order[:-1], order[1:]), heads, half):
            found.append((i, j, lcp(b, b_sizes, i, j), right))
        order = suffix_array(back, own)
        for i, j, left in _neighbours(order, lcp(b, b_sizes, order[:-1], order[1:]), heads, half):
            found.append((i, j, left, lcp(f, f_sizes, i, j)))
        if not found:
            return pd.DataFrame({"doc": [], "start": [], "end": []}, dtype=np.int64)
        i, j, left, right = (np.concatenate(c) for c in zip(*found))
        on = left + right >= units.length
        row, left, right = np.concatenate((i[on], j[on])), np.tile(left[on], 2), np.tile(right[on], 2)
        order = np.lexsort((-right, -left, row))
        row, left, right = row[order], left[order], right[order]
        # of a stretch's matches only those that reach further right than all that reach as far left
        wide = int(right.max(initial=0)) + 1
        reached = np.maximum.accumulate(row * wide + right)
        on = np.ones(len(row), dtype=bool)
        on[1:] = (row[1:] != row[:-1]) | (row[1:] * wide + right[1:] > reached[:-1])
        row, left, right = row[on], left[on], right[on]
        anchor = x["first"].to_numpy()[row] + lead[row]
        return pd.DataFrame({"doc": x["doc"].to_numpy()[row], "start": anchor - left, "end": anchor + right})

    return compare


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, text: str = "text", id: str = "doc_id", with_text: bool = False, crowd: int = repeats.CROWD, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated of every document (and kept: its remaining bytes)."""
    units = by_bytes(min(passage, length), length)
    rows = texts(docs, text, id)
    family = SuffixLevels(units, hot_heads(rows, units))
    for k in range(batches):
        family.add(rows.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k))
    found = stage(scan(family.met(), False, crowd), "found")
    for used in [*family.levels, *family.matched]:
        if used is not None:
            drop(used)

    def finish(data: bytes, starts, ends, a: np.ndarray, b: np.ndarray) -> tuple:
        every = zones.merged(a, b)
        long = b - a >= length
        a, b = zones.merged(a[long], b[long])
        at = np.concatenate(([0], b)), np.concatenate((a, [len(data)]))
        kept = b"".join(data[i:j] for i, j in zip(*at))
        out = (len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), int((every[1] - every[0]).sum()))
        return (*out, kept) if with_text else out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long" + ", kept binary" * with_text
    return spans(rows, found, units, common_strings(units), False, finish, schema, crowd)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
