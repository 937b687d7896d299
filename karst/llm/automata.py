"""Operator 9: repeated word passages, by suffix automata and matching statistics.

A suffix automaton of a reference holds every passage of it.  Streaming words
through it gives, word by word, the length of the longest passage ending there
that the reference holds (the matching statistic); every stretch of ``length``
words or more is a match.

``matches`` does that with a broadcast automaton for references of a proven size:
benchmark passages, licences.  ``remove_repeats_of_shards`` does it for a corpus
against itself, shard after shard, which costs the corpus times the number of its
shards.  ``remove_repeats``, which the query uses, therefore routes: only stretches
around anchors whose head occurs elsewhere are candidates (see ``repeats``), a
reference shard is what some heads have in common, and each candidate stretch is
streamed through the automaton of its own shard only, which holds all candidates that
start earlier.  No match crosses shards, as equal windows have equal heads.

Symbols are the words themselves, so unlike words never count as equal.

Defined results: null text is empty text; documents of fewer than ``length`` words
lose nothing; texts and words may be of any length; of equal passages the first, by
doc_id and then by place, stays; rows that share a doc_id are documents of their own,
in order of their text's xxhash64, rows without one too, and come first; an empty table
gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Hashable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, zones
from .repeats import by_words, finished, hot_heads, partial, scan, spans, texts
from .scratch import as_text, documents, stage

LENGTH = 20
#: Words of reference that may be broadcast.
BROADCAST_WORDS = 2_000_000
_SPACES = "[\\x20\\x09-\\x0D]+"


class Automaton:
    """A suffix automaton; each state also knows where its passages end first."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first = [-1]
        self.last = 0
        self.places = 0

    def add(self, symbols: Iterable[Hashable]) -> int:
        """Appends a passage; none reaches across from the one before. Returns the place of its first symbol."""
        nxt, link, size, first, last = self.next, self.link, self.size, self.first, self.last
        for c in ((self.places,), *symbols):  # first a symbol that occurs nowhere else
            new = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            first.append(self.places)
            self.places += 1
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new
        self.last = last
        return self.places - len(symbols)

    def _walk(self, symbols: list[Hashable]) -> Iterator[tuple[int, int]]:
        """For each symbol the length of the longest known passage that ends there, and its state."""
        nxt, link, size = self.next, self.link, self.size
        state, n = 0, 0
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                n = size[state]
            to = nxt[state].get(c)
            state, n = (0, 0) if to is None else (to, n + 1)
            yield n, state

    def statistics(self, symbols: list[Hashable]) -> np.ndarray:
        return np.array([n for n, _ in self._walk(symbols)], dtype=np.int64)

    def earlier(self, symbols: list[Hashable], length: int, place: int | None = None) -> np.ndarray:
        """Where windows of so many symbols end (the place behind) that are known, and before ``place``, where symbols start."""
        out = []
        for i, (n, state) in enumerate(self._walk(symbols)):
            if n >= length:
                while self.size[self.link[state]] >= length:
                    state = self.link[state]
                if place is None or self.first[state] < place + i:
                    out.append(i + 1)
        return np.array(out, dtype=np.int64)


def maximal_spans(statistics: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint [start, end) covered by matches of at least ``length``."""
    at = np.flatnonzero(statistics >= length)
    return zones.merged(at + 1 - statistics[at], at + 1)


def matches(docs: DataFrame, reference: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id", reference_text: str = "text", max_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, start, end) in words: the maximal spans of docs that the reference holds too.

    Refuses a reference of more than ``max_words`` words.
    """
    total = reference.agg(F.sum(F.regexp_count(F.concat(as_text(reference_text), F.lit(" ")), F.lit(_SPACES)))).first()[0] or 0
    if total > max_words:
        raise ValueError(f"the reference has about {total} words; at most {max_words} are broadcast")
    automaton = Automaton()
    for row in reference.select(as_text(reference_text).alias("t")).toLocalIterator():
        automaton.add(repeats.utf8(row["t"]).split())
    given = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc, t in zip(x["id"], x["text"]):
                a, b = maximal_spans(given.value.statistics(repeats.utf8(t).split()), length)
                out += [(doc, i, j) for i, j in zip(a.tolist(), b.tolist())]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end"])

    return docs.select(F.col(id).cast("long").alias("id"), as_text(text).alias("text")).mapInPandas(run, "doc_id long, start long, end long")


def remove_repeats_of_shards(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id", shard_words: int = BROADCAST_WORDS) -> DataFrame:
    """What ``remove_repeats`` returns, by broadcasting the corpus itself, shard by shard, as automata.

    A shard is a range of documents with about ``shard_words`` words.  Its automaton is streamed by
    its own documents and all behind them.  The work is the corpus times the number of its shards.
    """
    units = by_words(length)
    rows = texts(docs, text, id)
    sizes = rows.select("doc", F.regexp_count(F.concat("text", F.lit(" ")), F.lit(_SPACES)).alias("n"))
    shards = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // shard_words))
    ranged = stage(rows.select("doc", "text").repartitionByRange(shards, "doc").withColumn("shard", F.spark_partition_id()), "shards")
    found = docs.sparkSession.createDataFrame([], "doc long, start long, end long")
    for row in ranged.groupBy("shard").agg(F.min("doc").alias("least")).orderBy("shard").toLocalIterator():
        automaton, place = Automaton(), {}
        for r in ranged.filter(F.col("shard") == row["shard"]).orderBy("doc").toLocalIterator():
            place[r["doc"]] = automaton.add(units.form(r["text"]).split())
        given = docs.sparkSession.sparkContext.broadcast((automaton, place))

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            automaton, place = given.value
            for x in batches:
                out = []
                for doc, t in zip(x["doc"].tolist(), x["text"]):
                    end = automaton.earlier(units.form(t).split(), length, place.get(doc))
                    out += [(doc, i, j) for i, j in zip(*map(np.ndarray.tolist, zones.merged(end - length, end)))]
                yield pd.DataFrame(out, columns=["doc", "start", "end"])

        some = ranged.filter(F.col("doc") >= row["least"]).select("doc", "text").repartition(8).mapInPandas(run, "doc long, start long, end long")
        found = found.unionByName(stage(some, "matches"))
        given.unpersist()
    return finished(rows, found, units, _kept(False), SCHEMA)


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(with_text: bool):
    def finish(data: bytes, starts, ends, a: np.ndarray, b: np.ndarray) -> tuple:
        a, b = zones.merged(a, b)
        stay = np.ones(len(starts), dtype=bool)
        for i, j in zip(a, b):
            stay[i:j] = False
        kept = b" ".join([data[i:j] for i, j in zip(starts[stay].tolist(), ends[stay].tolist())])
        out = (len(starts), int((b - a).sum()), hashlib.sha256(kept).hexdigest())
        return (*out, kept.decode("utf-8")) if with_text else out

    return finish


def earlier_windows(length: int):
    """Streams the stretches of a shard in order of their start through the automaton of those before them."""

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc", "first"])
        automaton, out = Automaton(), []
        for doc, first, data in zip(x["doc"].tolist(), x["first"].tolist(), x["data"]):
            own = data.split(b" ")
            end = automaton.earlier(own, length)
            if len(end):
                a, b = zones.merged(end - length, end)
                out += [(doc, first + i, first + j) for i, j in zip(a.tolist(), b.tolist())]
            automaton.add(own)
        return pd.DataFrame(out, columns=["doc", "start", "end"])

    return compare


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id", with_text: bool = False, crowd: int = repeats.CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document (and kept: its remaining words)."""
    units = by_words(length)
    rows = texts(docs, text, id)
    found = stage(scan(partial(rows, units, hot_heads(rows, units)), True, crowd), "found")
    schema = SCHEMA + ", kept string" * with_text
    return spans(rows, found, units, earlier_windows(length), True, _kept(with_text), schema, crowd)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
