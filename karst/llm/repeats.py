"""The shared course of the two repeat finders (operators 6 and 9).

A unit is a byte or a word; a window is ``length`` units of one document.
Windows that occur more than once are found in these steps, all of them Spark
jobs over slim rows:

1. ``partial``: every document's anchors (see ``zones``), each with the digest of its
   *zone*, the stretch that its windows cover, up to ``reach`` units each.  A zone's
   copies within a batch of documents move as one row;
2. ``scan``: rows come together by head, in order of their zone.  Copies of a zone
   are repeated as a whole; of zones that differ under one head, one copy each goes on;
3. ``zone_units`` fetches their texts, and the operator compares them by its own
   method, head by head (``by_head``);
4. heads with more than ``crowd`` zones never meet in one task: their zones are
   ``cut`` into ranges of windows, each under a longer head, all that the windows of the
   range have in common, and scanned anew, until a range is a single window;
5. a document's intervals meet its text (``spans``).

Zones are told apart by 128-bit XXH3 digests of their own bytes, all else by the bytes.
Heads only bring together what may be equal.

Heads that a bounded sample of documents shows with many zones (``hot_heads``) are dealt
out over ``SALTS`` tasks from the start and count as crowded.  The sample decides nothing
but which task does the work.

``later`` tells which windows count: all that occur anywhere else (False), or
those that also start earlier, in a smaller doc_id or before in the document (True).

``doc`` is a key of the row, not its doc_id (see ``row_keys``): rows that share a
doc_id, or have none, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zones
from .row_keys import keyed
from .scratch import as_text, stage

#: Zones under one head that are compared in one task.
CROWD = 512
#: Zones that a task compares at a time.
TOGETHER = 1000
#: Documents sampled for heads with many zones, the share of them that makes a head hot, and how many tasks share one.
SAMPLE_DOCS, HOT_SHARE, MOST_HOT, SALTS = 4000, 0.01, 10_000, 64
#: Into how many ranges a crowded head's windows are cut at a time.
PARTS = 8
#: Characters of documents whose anchors are gathered together.
GATHER = 1 << 24
#: A spot is where a zone starts, how far behind its anchor stands, and its windows, in 10 bits each of the last two.
BITS = 10
KEYS = ("head", "salt", "z1", "z2", "doc", "spot")
PARTIAL = ", ".join(f"{k} long" for k in KEYS) + ", more array<long>"
_ARROW = pa.schema([(k, pa.int64()) for k in KEYS] + [("more", pa.list_(pa.int64()))])
WHOLE, BORDER, CROWDED = 0, 1, 2
_FOUND = pa.schema([("kind", pa.int32()), ("head", pa.int64()), ("doc", pa.int64()), ("spot", pa.int64())])
FOUND = "kind int, head long, doc long, spot long"
STRETCH = "head long, doc long, first long, lead long, windows long, data binary"


@dataclass(frozen=True)
class Units:
    """How texts are cut: form(text) gives the bytes, places(bytes) (64-bit values, starts, ends) of their units."""

    form: Callable[[str], bytes]
    places: Callable
    length: int
    reach: int
    head: int

    @property
    def leads(self) -> int:
        """How many windows can elect one anchor."""
        return self.length - self.head + 1


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _words(text: str) -> bytes:
    return b" ".join(utf8(text).split())  # bytes are split at \\x20 and \\x09-\\x0D


def byte_places(data: bytes):
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(len(raw) + 1)
    return zones.BYTE_VALUES[raw], at[:-1], at[1:]


def by_bytes(length: int, reach: int | None = None, head: int = 32) -> Units:
    return Units(utf8, byte_places, length, reach or length, min(head, length))


def by_words(length: int, head: int = 4) -> Units:
    return Units(_words, zones.word_values, length, length, min(head, length))


def texts(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(doc, text, id, bare): doc is the row's own key, in the order of the ids; bare rows have no id."""
    found = F.col(id).cast("long")
    rows = docs.select(as_text(text).alias("text"), F.coalesce(found, F.lit(0)).alias("id"), found.isNull().alias("bare"))
    return keyed(rows, F.when(~F.col("bare"), F.col("id")), "doc").select("doc", "text", "id", "bare")


# -- 1. anchors
def _document_anchors(doc: int, text: str, units: Units) -> tuple:
    data = units.form(text)
    values, starts, ends = units.places(data)
    a = zones.anchors(values, units.length, units.head)
    first, windows, lead = a["first"], a["windows"], a["lead"]
    if not len(first):
        return a["head"], first, first, first, first
    lo, hi = starts[first].tolist(), ends[np.minimum(first + windows + units.reach - 2, len(ends) - 1)].tolist()
    digests = b"".join(map(xxhash.xxh3_128_digest, [data[i:j] for i, j in zip(lo, hi)], lead.tolist()))
    z = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
    return a["head"], z[:, 0], z[:, 1], np.full(len(first), doc, dtype=np.int64), (first << 2 * BITS) + (lead << BITS) + windows


def _gathered(parts: list[tuple], hot: np.ndarray) -> pa.RecordBatch:
    """One row for each zone: its first place, and in ``more`` all others, a doc and a spot each in turn."""
    head, z1, z2, doc, spot = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((spot, doc, z1))
    head, z1, z2, doc, spot = head[order], z1[order], z2[order], doc[order], spot[order]
    fresh = np.ones(len(head), dtype=bool)
    fresh[1:] = (head[1:] != head[:-1]) | (z1[1:] != z1[:-1]) | (z2[1:] != z2[:-1])
    at = np.flatnonzero(fresh)
    copies = np.diff(np.append(at, len(head))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * copies))), pa.int32()), pa.array(np.stack((doc, spot), axis=1)[~fresh].ravel(), pa.int64()), mask=pa.array(copies == 0))
    salt = np.where(np.isin(head[at], hot), 1 + (z1[at] & (SALTS - 1)), 0)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (head[at], salt, z1[at], z2[at], doc[at], spot[at])] + [more], schema=_ARROW)


def partial(rows: DataFrame, units: Units, hot: list[int] = ()) -> DataFrame:
    """The zones of each batch of documents: KEYS and more."""
    if units.leads >= 1 << BITS:
        raise ValueError("windows are too long for their heads")
    hot = np.array(sorted(hot), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            parts, held = [], 0
            for doc, text in zip(x.column("doc").to_pylist(), x.column("text")):
                text = text.as_py()
                parts.append(_document_anchors(doc, text, units))
                held += len(text)
                if held > GATHER:
                    yield _gathered(parts, hot)
                    parts, held = [], 0
            if parts:
                yield _gathered(parts, hot)

    return rows.select("doc", "text").mapInArrow(run, PARTIAL)


def hot_heads(rows: DataFrame, units: Units) -> list[int]:
    """Heads of many zones in a sample of about SAMPLE_DOCS documents."""
    share = max(1, rows.count() // SAMPLE_DOCS)
    some = partial(rows.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0), units)
    held = some.select("head", "z1").distinct().groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    return [r["head"] for r in held.filter(F.col("n") > HOT_SHARE * SAMPLE_DOCS).orderBy(F.desc("n"), "head").limit(MOST_HOT).collect()]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of one head, or of one share of a hot one, together and in order."""
    return rows.repartition("head", "salt").sortWithinPartitions(*KEYS)


# -- 2. scan
def _differ(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _told(kind: int | np.ndarray, head: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(doc), kind, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(head, pa.int64()), pa.array(doc, pa.int64()), pa.array(spot, pa.int64())], schema=_FOUND)


class _Scan:
    """Follows rows in order; holds the zones of the last head, one row each, and never many more than a crowd of them."""

    def __init__(self, later: bool, crowd: int):
        self.later, self.crowd = later, crowd
        self.held, self.many = [np.zeros(0, dtype=np.int64)] * len(KEYS), np.zeros(0, dtype=bool)
        self.open = None  # a head found crowded, of which more may come

    def settle(self, z: list[np.ndarray], many: np.ndarray, crowded_last: bool) -> Iterator[pa.RecordBatch]:
        """What follows from zones of which all copies have been seen."""
        if not len(many):
            return
        head, salt, _, _, doc, spot = z
        if not self.later and many.any():
            yield _told(WHOLE, head[many], doc[many], spot[many])
        fresh = _differ([head, salt])
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)[group]
        crowded = (size > self.crowd) | (salt > 0)
        if self.open == (head[0], salt[0]):
            crowded |= group == 0
        if crowded_last:
            crowded |= group == group[-1]
        on = crowded | (size > 1)
        if on.any():
            yield _told(np.where(crowded, CROWDED, BORDER)[on], head[on], doc[on], spot[on])

    def rows(self, x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns, lists = [np.concatenate((h, x.column(k).to_numpy())) for h, k in zip(self.held, KEYS)], x.column("more")
        n = len(columns[0])
        if not n:
            return
        others = lists.flatten().to_numpy().reshape(-1, 2)
        if len(others):
            yield _told(WHOLE, np.zeros(len(others), np.int64), others[:, 0], others[:, 1])
        many = np.concatenate((self.many, pc.fill_null(pc.list_value_length(lists), 0).to_numpy() > 0))
        fresh = _differ(columns[:4])
        if not fresh.all():
            yield _told(WHOLE, columns[0][~fresh], columns[4][~fresh], columns[5][~fresh])
        at = np.flatnonzero(fresh)
        many = np.logical_or.reduceat(many, at) | (np.diff(np.append(at, n)) > 1)
        z = [c[at] for c in columns]
        last = int(np.flatnonzero(_differ(z[:2]))[-1])
        key = (z[0][-1], z[1][-1])
        crowded = self.open == key or len(at) - last > self.crowd
        done = len(at) - 1 if crowded else last
        yield from self.settle([c[:done] for c in z], many[:done], crowded and done > last)
        self.held, self.many = [c[done:] for c in z], many[done:]
        self.open = key if crowded else None

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle(self.held, self.many, False)


def scan(rows: DataFrame, later: bool, crowd: int = CROWD) -> DataFrame:
    """(kind, head, doc, spot) from partial rows: copies of zones, and one of each zone under heads with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Scan(later, crowd)
        for x in batches:
            yield from state.rows(x)
        yield from state.end()

    return dealt(rows.select(*KEYS, "more")).mapInArrow(run, FOUND)


# -- 3. stretches and their comparison
def zone_units(found: DataFrame, rows: DataFrame, units: Units) -> DataFrame:
    """STRETCH of each zone of (head, doc, spot); data are its units' bytes."""
    want = found.groupBy("doc").agg(F.collect_list(F.struct("head", "spot")).alias("want"))
    mask = (1 << BITS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out, held = [], 0
            for doc, text, want in zip(x["doc"].tolist(), x["text"], x["want"]):
                data = units.form(text)
                _, starts, ends = units.places(data)
                for w in want:
                    first, lead, windows = w["spot"] >> 2 * BITS, w["spot"] >> BITS & mask, w["spot"] & mask
                    part = data[starts[first] : ends[min(first + windows + units.reach - 2, len(ends) - 1)]]
                    out.append((w["head"], doc, first, lead, windows, part))
                    held += len(part)
                if held > GATHER:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in STRETCH.split(", ")]
    return rows.join(want, "doc").select("doc", "text", "want").mapInPandas(run, STRETCH)


def by_head(rows: DataFrame, compare: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(doc, start, end): compare() of some whole heads at a time, not many more than ``TOGETHER`` rows and a crowd."""

    def some(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        heads = x["head"].to_numpy()
        ends = np.append(np.flatnonzero(heads[1:] != heads[:-1]) + 1, len(x))
        at = 0
        while at < len(x):
            to = int(ends[min(np.searchsorted(ends, at + TOGETHER), len(ends) - 1)])
            yield compare(x.iloc[at:to])
            at = to

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for x in batches:
            x = x if rest is None else pd.concat((rest, x), ignore_index=True)
            if not len(x):
                continue
            heads = x["head"].to_numpy()
            cut = int(np.flatnonzero(heads != heads[-1])[-1] + 1) if heads[0] != heads[-1] else 0
            yield from some(x.iloc[:cut])
            rest = x.iloc[cut:]
        if rest is not None:
            yield from some(rest)

    return rows.repartition("head").sortWithinPartitions("head").mapInPandas(run, "doc long, start long, end long")


# -- 4. crowded heads
def cut(rows: DataFrame, units: Units, width: int) -> DataFrame:
    """The stretches in ranges of up to ``width`` windows, with digests, under the head that a whole range has in common.

    A window's range follows from how far its anchor stands behind its start, so equal windows get equal heads.
    """
    names = [c.split()[0] for c in STRETCH.split(", ")] + ["z1", "z2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for doc, first, lead, windows, data in zip(*(x[c].tolist() for c in ("doc", "first", "lead", "windows", "data"))):
                _, starts, ends = units.places(data)
                for k in range((lead - windows + 1) // width, lead // width + 1):
                    i, j = max(lead - (k + 1) * width + 1, 0), min(lead - k * width, windows - 1)
                    a, b = lead - k * width, lead - min((k + 1) * width, units.leads) + 1 + units.length
                    own = xxhash.xxh3_64_intdigest(data[starts[a] : ends[b - 1]], k << BITS | width) - (1 << 63)
                    part = data[starts[i] : ends[min(j + units.reach, len(ends)) - 1]]
                    z = np.frombuffer(xxhash.xxh3_128_digest(part, lead - i), dtype="<i8").tolist()
                    out.append((own, doc, first + i, lead - i, j - i + 1, part, *z))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, STRETCH + ", z1 long, z2 long")


def _spot() -> F.Column:
    return F.shiftleft("first", 2 * BITS) + F.shiftleft("lead", BITS) + F.col("windows")


def _interval(found: DataFrame, units: Units, windows: F.Column | None = None, reach: int | None = None) -> DataFrame:
    start = F.shiftright("spot", 2 * BITS)
    windows = F.col("spot").bitwiseAND((1 << BITS) - 1) if windows is None else windows
    return found.select("doc", start.alias("start"), (start + windows + ((reach or units.reach) - 1)).alias("end"))


def crowded_intervals(rows: DataFrame, units: Units, compare: Callable, later: bool, crowd: int) -> list[DataFrame]:
    """Intervals among stretches under crowded heads."""
    out, width = [], units.leads
    while True:
        width = -(-width // PARTS)
        ranges = stage(cut(rows, units, width).withColumn("spot", _spot()), "ranges")
        slim = ranges.select("head", F.lit(0).cast("long").alias("salt"), "z1", "z2", "doc", "spot", F.lit(None).cast("array<long>").alias("more"))
        found = stage(scan(slim, later, crowd), "ranges-found")
        out.append(_interval(found.filter(F.col("kind") == WHOLE), units))
        on = ranges.join(found.filter(F.col("kind") == BORDER).select("doc", "spot", "head"), ["doc", "spot", "head"], "left_semi")
        out.append(by_head(on, compare))
        crowded = found.filter(F.col("kind") == CROWDED)
        if width == 1:
            # one window each, equal in its ``length`` units, of which the digest is the head; of unlike reach
            if units.reach > units.length:
                out.append(_interval(crowded, units, F.lit(1), units.length))
            return out
        if crowded.isEmpty():
            return out
        rows = ranges.join(crowded.select("doc", "spot", "head"), ["doc", "spot", "head"], "left_semi")


# -- 5. intervals and texts
def intervals(rows: DataFrame, found: DataFrame, units: Units, compare: Callable[[pd.DataFrame], pd.DataFrame], later: bool, crowd: int = CROWD) -> DataFrame:
    """(doc, start, end) in units: stretches, with overlaps, that occur as a whole elsewhere (or earlier) too.

    Their windows are just the repeated windows.
    """
    out = _interval(found.filter(F.col("kind") == WHOLE), units)
    border = found.filter(F.col("kind") == BORDER)
    if not border.isEmpty():
        out = out.unionByName(by_head(zone_units(border, rows, units), compare))
    crowded = found.filter(F.col("kind") == CROWDED)
    if not crowded.isEmpty():
        for more in crowded_intervals(zone_units(crowded, rows, units), units, compare, later, crowd):
            out = out.unionByName(more)
    return out


def spans(rows: DataFrame, found: DataFrame, units: Units, compare, later: bool, finish: Callable, schema: str, crowd: int = CROWD) -> DataFrame:
    """doc_id and finish(data, starts, ends of the units, starts, ends of the intervals) of every row of ``texts``."""
    return finished(rows, intervals(rows, found, units, compare, later, crowd), units, finish, schema)


def finished(rows: DataFrame, by_doc: DataFrame, units: Units, finish: Callable, schema: str) -> DataFrame:
    packed = F.shiftleft("start", 20) + (F.col("end") - F.col("start"))  # an interval is a zone's at most
    by_doc = by_doc.groupBy("doc").agg(F.collect_set(packed).alias("cuts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for id, bare, text, cuts in zip(x["id"].tolist(), x["bare"].tolist(), x["text"], x["cuts"]):
                data = units.form(text)
                _, starts, ends = units.places(data)
                cuts = np.array([] if cuts is None else cuts, dtype=np.int64)
                a = cuts >> 20
                out.append((id, *finish(data, starts, ends, a, np.minimum(a + (cuts & ((1 << 20) - 1)), len(starts))), bare))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in full.split(", ")])

    names = [c.split()[0] for c in schema.split(", ")]
    full = schema + ", bare boolean"
    done = rows.join(by_doc, "doc", "left").mapInPandas(run, full)
    return done.select(F.when(~F.col("bare"), F.col(names[0])).alias(names[0]), *names[1:])
