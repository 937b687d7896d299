"""Content-chosen anchors: the shared groundwork of the two repeat finders.

A repeat of at least ``length`` symbols (bytes or words) is found from far fewer
points than there are positions.  Every window of ``length`` symbols elects the
smallest ``head``-gram inside it, by a hash (leftmost among equals), so equal
windows elect the same gram at the same offset wherever they stand.  An *anchor*
is a gram that some window elects.  Two equal windows always belong to anchors
with equal head hashes.

These hashes only choose and route: symbols that collide choose the same anchors,
which costs a comparison and decides nothing.  All of it is numpy over one document,
in blocks of at most ``BLOCK`` symbols, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

import numpy as np

#: Symbols handled at once; a power of two that fits the position bits below.
BLOCK = 1 << 18
_POS_BITS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_SPAN = BLOCK + 4096
_POW = _powers(_BASE, _SPAN)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SPAN)
#: A fixed odd 64-bit value for every byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit values, so that every bit counts."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``gram`` reads the hash of any stretch."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _POW[: len(values)], out=out[1:])
    return out


def gram(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(np.uint64))


def word_values(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit value, start, end) of each word, a run of bytes other than \\x20 and \\x09-\\x0D."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    np.take(_IN_WORD, raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    values = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        # as many words as end within one block; a longer word is hashed alone, piece by piece
        j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
        if j <= i:
            h = np.uint64(0)
            for at in range(int(starts[i]), int(ends[i]), BLOCK):
                part = BYTE_VALUES[raw[at : min(at + BLOCK, int(ends[i]))]]
                s = prefix(part)
                h = mix(np.array([h + s[-1] + np.uint64(len(part))], dtype=np.uint64))[0]
            values[i] = h
            i += 1
            continue
        lo = int(starts[i])
        s = prefix(BYTE_VALUES[raw[lo : int(ends[j - 1])]])
        values[i:j] = gram(s, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return values | np.uint64(1), starts, ends


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    padded = np.full(-(-n // width) * width, np.uint64(_MASK), dtype=np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(values: np.ndarray, length: int, head: int) -> dict[str, np.ndarray]:
    """The anchors of one sequence of symbols.

    first, windows: the windows that elect the anchor start at first, first+1, ...;
    lead: how far the anchor stands behind ``first``; head: its 64-bit hash as a
    signed integer.  Empty arrays where the sequence is shorter than ``length``.
    """
    parts = []
    n = len(values)
    at = 0
    while n - at >= length:
        block = values[at : at + BLOCK + length - 1]
        sums = prefix(block)
        spots = np.arange(len(block) - head + 1)
        grams = gram(sums, spots, spots + head)
        low = _sliding_min((grams & ~_POS_BITS) | spots.astype(np.uint64), length - head + 1)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        stop = np.append(first[1:], len(low))
        spot = (low[first] & _POS_BITS).astype(np.int64)
        parts.append((first + at, stop - first, spot - first, grams[spot].view(np.int64)))
        at += BLOCK
    names = ("first", "windows", "lead", "head")
    if not parts:
        return {k: np.zeros(0, dtype=np.int64) for k in names}
    return {k: np.concatenate([p[i] for p in parts]) for i, k in enumerate(names)}


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, as disjoint, non-touching ones in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], np.append(ends[:-1][new[1:]], ends[-1])
