"""Native expressions on rings: arrays of (x, y) structs, closed, z = 0, metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed counter-clockwise ring."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def is_closed(ring: Column) -> Column:
    return (F.size(ring) >= 3) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def ring_or_null(ring: Column) -> Column:
    """Null unless the ring has three points and is closed."""
    return F.when(is_closed(ring), ring)


def edges(ring: Column) -> Column:
    """Segments (x0, y0, x1, y1) between neighbouring points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["x0"] * e["y1"] - e["x1"] * e["y0"]), lambda s: s / 2)


def area(ring: Column) -> Column:
    """Area of a ring, rounded to 6; null ring: 0."""
    return F.round(F.coalesce(F.abs(signed_area(ring)), F.lit(0.0)), 6)


def parcel_area(ring: Column, holes: Column) -> Column:
    """Outer ring less holes, each rounded to 6 before."""
    return F.round(area(ring) - F.aggregate(F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0.0), lambda s, h: s + area(h)), 6)


def bbox(ring: Column) -> Column:
    """(x0, y0, x1, y1), null for a null ring."""
    lo, hi = F.array_min, F.array_max
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.when(ring.isNotNull(), F.struct(lo(xs).alias("x0"), lo(ys).alias("y0"), hi(xs).alias("x1"), hi(ys).alias("y1")))


def translate(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def ring_key(ring: Column) -> Column:
    """Points rounded to millimetres: rings with equal keys count as one shape."""
    return F.transform(ring, lambda p: point(F.round(p["x"], 3), F.round(p["y"], 3)))


def north_edges(ring: Column) -> Column:
    """Edges whose inward normal points south by at least one degree: what faces north."""
    turn = F.signum(signed_area(ring))
    limit = F.lit(0.01745240643728351)
    return F.filter(edges(ring), lambda e: -turn * (e["x1"] - e["x0"]) >= limit * F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))


def lift(ring: Column, z: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.cast("double").alias("z")))


def split_parts(points: Column, parts: Column) -> Column:
    """Rings of a shape: points cut at the part offsets."""
    ends = F.concat(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.size(points)))
    return F.transform(F.array(points), lambda ps: F.transform(F.zip_with(parts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda r: F.slice(ps, r["s"] + 1, r["e"] - r["s"])))[0]


def outer_ring(rings: Column) -> Column:
    """The first part; closed when it is the only one and open with three points; null when it stays open."""
    first = F.get(rings, F.lit(0))
    closed = F.when((F.size(rings) == 1) & (F.size(first) >= 3) & ~is_closed(first), F.concat(first, F.slice(first, 1, 1))).otherwise(first)
    return ring_or_null(closed)


def hole_rings(rings: Column) -> Column:
    """All later parts that are closed."""
    return F.filter(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), is_closed)
