"""Operator 10: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is an
entry as a whole costs one hash, one probe and one comparison of bytes.  Tier two
merges what misses: its bytes form a linked list, a heap holds the pairs that
merge by rank, and stale pairs are skipped.  Both halves of a pair are entries, so
a pair is known by their two ids and its bytes are not hashed again.  What a worker
has already seen comes from a bounded cache: pre-tokens, and chunks from one space to
the next, as far as the pattern never looks across a space that a word follows.  The
tables (as large as the vocabulary file, whatever the input) are built on the driver
and broadcast.

Defined results: null text is empty text with no ids; unpaired surrogates become
U+FFFD as they cannot be written in UTF-8; repeated rows get equal rows; an empty
table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import as_text, documents

#: Pre-tokens and chunks kept by a worker; beyond it the cache starts anew.
CACHE = 1_500_000
#: Characters of the longest pre-token or chunk that is kept.
KEPT = 64
#: Characters after which a long text is cut at the next place where a chunk begins.
BLOCK = 1 << 20
#: Bytes of ids gathered before they are handed on.
FLUSH = 1 << 24
#: Ids written out or decoded at once.
STEP = 1 << 20
#: Patterns for which a match begins at every space that no white space follows, and the text before that space is
#: matched as if it ended there: no match runs on from other characters into white space, a run of white space leaves
#: its last space to the word behind it, and the only look ahead finds the same at a space as at the end of the text.
SPACED = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
_CUT = re.compile(r" (?=\S)")
_M = (1 << 64) - 1

_hash = xxhash.xxh3_64_intdigest


def _place(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _M
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """A minimal perfect hash: n keys, n slots, one displacement for each of n buckets.

    Buckets of several keys look for a displacement that sends all of them to free
    slots, the fullest first; a bucket of one key then names its slot outright.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.shift = [0] * n
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        buckets: list[list[int]] = [[] for _ in range(n)]
        hashes = [_hash(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % n].append(i)
        order = sorted((b for b in range(n) if buckets[b]), key=lambda b: -len(buckets[b]))
        free = iter(range(n))
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                at = next(s for s in free if self.slots[s] is None)
                self.shift[b] = -at - 1
                self.slots[at], self.values[at] = keys[own[0]], own[0]
                continue
            d = 1
            while True:
                spots = [_place(hashes[i], d, n) for i in own]
                if len(set(spots)) == len(spots) and all(self.slots[s] is None for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, spots):
                self.slots[s], self.values[s] = keys[i], i

    def get(self, key: bytes) -> int:
        """The position of key in the list given, or -1."""
        if not self.n:
            return -1
        h = _hash(key)
        d = self.shift[h % self.n]
        s = -d - 1 if d < 0 else _place(h, d, self.n)
        return self.values[s] if self.slots[s] == key else -1


class _Uneven(Exception):
    """White space follows a space, so a chunk doesn't begin there."""


class _Words(dict):
    """pre-token -> its packed ids."""

    def __init__(self, pack):
        self.pack = pack

    def __missing__(self, token: str) -> bytes:
        packed = self.pack(token)
        if len(token) <= KEPT:
            self[token] = packed
        return packed


class _Chunks(dict):
    """what stands between a space and the next chunk -> packed ids of both, the space in front included."""

    def __init__(self, find, words: _Words, scan):
        self.find, self.words, self.scan = find, words, scan

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Uneven
        if len(chunk) > KEPT:
            return self.scan(" " + chunk)
        if chunk.isascii() and chunk.isalpha():
            packed = self.words.pack(" " + chunk)
        else:
            first, *rest = self.find(" " + chunk)
            # the first pre-token is a chunk of its own where others follow, so it is kept once
            packed = self[first[1:]] + b"".join(map(self.words.__getitem__, rest)) if rest else self.words.pack(first)
        self[chunk] = packed
        return packed


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = sorted(ranks, key=ranks.get)
        self.pattern = pattern
        self.index = PerfectHash(tokens)
        self.rank = [ranks[t] for t in tokens]
        self.token = [b""] * (max(self.rank, default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        # merging starts from single bytes; for each id the ids that may follow it, with what the two merge to
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        none: dict[int, int] = {}
        self.pair = [none] * len(self.token)
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    left = ranks[t[:i]]
                    if self.pair[left] is none:
                        self.pair[left] = {}
                    self.pair[left][ranks[t[i:]]] = r
        self.chunks = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "words")} | {"chunks": None}

    def _open(self) -> None:
        """The caches of this process."""
        import regex

        self.find = regex.compile(self.pattern)
        self.words = _Words(self._pack)
        self.chunks = _Chunks(self.find.findall, self.words, self._scan)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        """From a file of base64 tokens and their ranks."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}, pattern)

    def lookup(self, key: bytes) -> int:
        """The rank of a vocabulary entry, or -1."""
        i = self.index.get(key)
        return self.rank[i] if i >= 0 else -1

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: the lowest rank merges first, the leftmost of equals."""
        n, pair = len(word), self.pair
        ids = [self.single[b] for b in word]
        if -1 in ids:
            raise ValueError("the vocabulary lacks a single byte of this text")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank to which the part at a place merges with the one after it, or -1; the heap has rank and place in one number
        due = [pair[a].get(b, -1) for a, b in zip(ids, ids[1:])]
        due.append(-1)
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(due) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & low, top >> bits
            if due[i] != r:
                continue  # one of its halves has merged meanwhile
            gone = after[i]
            ids[i], ids[gone], due[gone] = r, -1, -1
            j = after[i] = after[gone]
            if j < n:
                before[j] = i
                s = due[i] = pair[r].get(ids[j], -1)
                if s >= 0:
                    heappush(heap, s << bits | i)
            else:
                due[i] = -1
            k = before[i]
            if k >= 0:
                s = due[k] = pair[ids[k]].get(r, -1)
                if s >= 0:
                    heappush(heap, s << bits | k)
        return [x for x in ids if x >= 0]

    def _pack(self, token: str) -> bytes:
        key = token.encode("utf-8", "replace")
        r = self.lookup(key)
        ids = [r] if r >= 0 else self.merge(key)
        return pack(f"<{len(ids)}i", *ids)

    def _scan(self, text: str) -> bytes:
        """By the pattern alone."""
        if len(text) < BLOCK:
            return b"".join(map(self.words.__getitem__, self.find.findall(text)))
        found, parts = self.find.finditer(text), []
        while some := [m.group() for m in islice(found, 1 << 16)]:
            parts.append(b"".join(map(self.words.__getitem__, some)))
            self._bound()
        return b"".join(parts)

    def _block(self, text: str) -> bytes:
        """Chunk by chunk."""
        self._bound()
        first, *rest = text.split(" ")
        try:
            found = b"".join(map(self.chunks.__getitem__, rest))
        except _Uneven:
            first, *rest = _CUT.split(text)
            found = b"".join(map(self.chunks.__getitem__, rest))
        return self._scan(first) + found

    def _bound(self) -> None:
        if len(self.words) + len(self.chunks) > CACHE:
            self.words.clear()
            self.chunks.clear()

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        if self.chunks is None:
            self._open()
        if self.pattern not in SPACED:
            self._bound()
            return self._scan(text)
        if len(text) <= BLOCK:
            return self._block(text)
        parts, lo = [], 0
        while m := _CUT.search(text, lo + BLOCK):
            parts.append(self._block(text[lo : m.start()]))
            lo = m.start()
        return b"".join(parts) + self._block(text[lo:])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<i4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, codec: Codec, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids, own, held = [], [], 0
            for d, t in zip(x["id"], x["text"]):
                own.append(d)
                ids.append(shared.value.encode(t))
                held += ids[-1].nbytes
                if held > FLUSH:
                    yield pd.DataFrame({"doc_id": own, "ids": ids})
                    ids, own, held = [], [], 0
            yield pd.DataFrame({"doc_id": own, "ids": ids})

    return docs.select(F.col(id).cast("long").alias("id"), as_text(text).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, data binary): the bytes that the ids of every row stand for; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "data": [shared.value.decode([] if ids is None else ids) for ids in x["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def _digests(entries: pa.Array, ids: np.ndarray, ends: list[int], lead: int) -> list[str]:
    """SHA-256 of the entries that each row's ids name, joined; the first lead bytes of a row are left out.  ends: of the rows among ids."""
    sums, row, start = [hashlib.sha256() for _ in ends], 0, 0
    for lo in range(0, len(ids), STEP):
        hi = min(lo + STEP, len(ids))
        _, places, data = entries.take(pa.array(ids[lo:hi])).buffers()
        at, data = np.frombuffer(places, "<i8"), memoryview(data)
        while row < len(ends):
            a, b = max(start, lo), min(ends[row], hi)
            if a < b:
                sums[row].update(data[at[a - lo] + (lead if a == start else 0) : at[b - lo]])
            if ends[row] > hi:
                break
            start = ends[row]
            row += 1
    return [x.hexdigest() for x in sums]


def round_trip(docs: DataFrame, codec: Codec, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the bytes they decode to; ids stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.value
        decimal = pa.array([b" %d" % i for i in range(len(codec.token))], pa.large_binary())
        token = pa.array(codec.token, pa.large_binary())

        def rows(own: list, parts: list[bytes]) -> pd.DataFrame:
            ids, lengths = np.frombuffer(b"".join(parts), "<i4"), [len(p) // 4 for p in parts]
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            return pd.DataFrame({"doc_id": own, "n_tokens": lengths, "ids_sha256": _digests(decimal, ids, ends, 1), "decoded_sha256": _digests(token, ids, ends, 0)})

        for x in batches:
            own, parts, held = [], [], 0
            for d, t in zip(x["id"], x["text"]):
                own.append(d)
                parts.append(codec.packed(t))
                held += len(parts[-1])
                if held > 4 * STEP:
                    yield rows(own, parts)
                    own, parts, held = [], [], 0
            yield rows(own, parts)

    return docs.select(F.col(id).cast("long").alias("id"), as_text(text).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return round_trip(documents(spark, sf_dir), codec)
