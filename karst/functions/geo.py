"""Points are STRUCT<lng, lat>; a polygon is an array of points, its ring, closed or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import col

RADIUS = 6371008.8
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _edges(ring) -> Column:
    """(p, q) of each edge; the last point joins the first."""
    r = col(ring)
    following = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    return F.zip_with(r, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, e: a + e)


def area(ring) -> Column:
    """Square metres on the sphere."""
    each = F.transform(_edges(ring), lambda e: F.radians(e["q"]["lng"] - e["p"]["lng"]) * (2 + F.sin(F.radians(e["p"]["lat"])) + F.sin(F.radians(e["q"]["lat"]))))
    return F.abs(_total(each)) * (RADIUS * RADIUS / 2)


def bearing(a, b) -> Column:
    """Degrees at the start, from -180 to 180."""
    p, q = col(a), col(b)
    d = F.radians(q["lng"] - p["lng"])
    x, y = F.radians(p["lat"]), F.radians(q["lat"])
    return F.degrees(F.atan2(F.sin(d) * F.cos(y), F.cos(x) * F.sin(y) - F.sin(x) * F.cos(y) * F.cos(d)))


def centroid(ring) -> Column:
    """Of the plane polygon; for one without area, the mean of its points."""
    w = lambda e: e["p"]["lng"] * e["q"]["lat"] - e["q"]["lng"] * e["p"]["lat"]
    edges = _edges(ring)
    twice = F.nullif(_total(F.transform(edges, w)), F.lit(0.0))
    mid = lambda k: _total(F.transform(edges, lambda e: (e["p"][k] + e["q"][k]) * w(e))) / (3 * twice)
    mean = lambda k: _total(F.transform(col(ring), lambda p: p[k])) / F.size(col(ring))
    return F.struct(*(F.coalesce(mid(k), mean(k)).alias(k) for k in ("lng", "lat")))


def distance(a, b) -> Column:
    """Metres along the great circle."""
    p, q = col(a), col(b)
    half = lambda k: F.pow(F.sin(F.radians(q[k] - p[k]) / 2), F.lit(2.0))
    h = half("lat") + F.cos(F.radians(p["lat"])) * F.cos(F.radians(q["lat"])) * half("lng")
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def hash_encode(point, length: int = 12) -> Column:
    """Geohash of up to 12 characters."""
    if not 1 <= length <= 12:
        raise ValueError("a geohash has 1 to 12 characters")
    p, scale = col(point), 1 << 30
    lng = F.least(F.floor((p["lng"] + 180) / 360 * scale), F.lit(scale - 1)).cast("long")
    lat = F.least(F.floor((p["lat"] + 90) / 180 * scale), F.lit(scale - 1)).cast("long")
    chars = []
    for c in range(length):
        index = F.lit(0)
        for b in range(5 * c, 5 * c + 5):
            bit = F.shiftright(lat if b % 2 else lng, 29 - b // 2).bitwiseAND(1)
            index = index * 2 + bit
        chars.append(F.substring(F.lit(ALPHABET), index.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def hash_decode(code) -> Column:
    """The middle of a geohash's cell."""
    text = col(code)
    n = F.char_length(text)
    start = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x0", -180), ("x1", 180), ("y0", -90), ("y1", 90))), F.lit(True).alias("even"))

    def half(s: Column, bit: Column) -> Column:
        x, y = (s["x0"] + s["x1"]) / 2, (s["y0"] + s["y1"]) / 2
        up, even = bit == 1, s["even"]
        return F.struct(
            F.when(even & up, x).otherwise(s["x0"]).alias("x0"),
            F.when(even & ~up, x).otherwise(s["x1"]).alias("x1"),
            F.when(~even & up, y).otherwise(s["y0"]).alias("y0"),
            F.when(~even & ~up, y).otherwise(s["y1"]).alias("y1"),
            (~even).alias("even"),
        )

    bits = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: _bits(text, i)))
    cell = F.aggregate(bits, start, half)
    return F.struct(((cell["x0"] + cell["x1"]) / 2).alias("lng"), ((cell["y0"] + cell["y1"]) / 2).alias("lat"))


def _bits(text: Column, i: Column) -> Column:
    """The five bits of the i-th character, highest first."""
    index = F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1))) - 1
    return F.array(*(F.shiftright(index, k).bitwiseAND(1) for k in (4, 3, 2, 1, 0)))


def is_valid(point) -> Column:
    p = col(point)
    return F.coalesce(p["lng"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False))


def within(point, ring) -> Column:
    """Whether a point lies in a polygon: a ray to the east crosses an odd number of edges."""
    x, y = col(point)["lng"], col(point)["lat"]

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["lat"] > y) != (q["lat"] > y)
        at = (q["lng"] - p["lng"]) * (y - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lng"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(_edges(ring), crosses), F.lit(0), lambda a, e: a + e) % 2 == 1
