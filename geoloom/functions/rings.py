"""Rings against point and box columns: one known when the plan is made, whose edges become a literal array, or a column
of rings, one a row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, contains, intersects, lon_span, wrap_longitude
from geoloom.request import EPS, BBox, Polygon


class Ring(NamedTuple):
    """Rings as columns: edges (x1, y1, x2, y2 each, longitudes running on across 180 degrees) and their box."""

    edges: Column
    box: Box
    #: The first longitude, and the middle of all.
    first: Column
    middle: Column

    @classmethod
    def of(cls, ring: Polygon) -> Ring:
        edges = F.array(*[F.array(*map(F.lit, (*a, *b))) for a, b in zip(ring.plane, ring.plane[1:], strict=False)])
        xs = [p[0] for p in ring.plane]
        return cls(edges, Box.of(*ring.bbox.edges), F.lit(xs[0]), F.lit((min(xs) + max(xs)) / 2))

    @classmethod
    def col(cls, plane: Column) -> Ring:
        """Of a column of closed planes: positions (x, y) whose longitudes run on."""
        xs, ys = F.transform(plane, lambda p: p["x"]), F.transform(plane, lambda p: p["y"])
        west, east = F.array_min(xs), F.array_max(xs)
        whole = east - west >= 360
        box = Box(F.when(whole, -180.0).otherwise(wrap_longitude(west)), F.array_min(ys), F.when(whole, 180.0).otherwise(wrap_longitude(east)), F.array_max(ys))
        edges = F.zip_with(F.slice(plane, 1, F.size(plane) - 1), F.slice(plane, 2, F.size(plane) - 1), lambda a, b: F.array(a["x"], a["y"], b["x"], b["y"]))
        return cls(edges, box, xs[0], (west + east) / 2)

    @classmethod
    def stored(cls, name: str = "ring") -> Ring:
        """Of a struct column that `Ring.struct` made, so that edges and boxes are worked out once a ring."""
        return cls(F.col(f"{name}.edges"), Box.col(f"{name}.box"), F.col(f"{name}.first"), F.col(f"{name}.middle"))

    def struct(self) -> Column:
        return F.struct(self.edges.alias("edges"), self.box.struct().alias("box"), self.first.alias("first"), self.middle.alias("middle"))


def unwrapped(ring: Column) -> Column:
    """A column of closed rings (arrays of lon, lat) as planes (x, y): each longitude within half a turn of the one before.
    Null for a ring about a pole, one that isn't closed, or one of under four positions."""
    start = F.struct(F.array().cast("array<struct<x:double,y:double>>").alias("plane"), F.element_at(ring, 1)[0].alias("x"))

    def run_on(found: Column, p: Column) -> Column:
        x = p[0] - 360 * F.bround((p[0] - found["x"]) / 360)
        return F.struct(F.concat(found["plane"], F.array(F.struct(x.alias("x"), p[1].alias("y")))).alias("plane"), x.alias("x"))

    plane = F.aggregate(ring, start, run_on, lambda found: found["plane"])

    def closed(p: Column) -> Column:
        xs = F.transform(p, lambda q: q["x"])
        last = F.element_at(p, -1)
        shut = (F.abs(last["x"] - p[0]["x"]) <= 1e-6) & (F.abs(last["y"] - p[0]["y"]) <= 1e-6)
        return F.when(shut & (F.array_max(xs) - F.array_min(xs) < 360), p)

    return F.when(F.size(ring) >= 4, _let(plane, closed))


def _edges(ring: Polygon | Ring) -> Column:
    """x1, y1, x2, y2 of every edge."""
    return (ring if isinstance(ring, Ring) else Ring.of(ring)).edges


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _near(lon: Column, middle: Column | float) -> Column:
    """lon, moved by whole turns to within half a turn of middle."""
    return F.when(lon - middle > 180, lon - 360).when(middle - lon > 180, lon + 360).otherwise(lon)


def _cross(e: Column, x: Column, y: Column) -> Column:
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def _between(a: Column, b: Column, v: Column) -> Column:
    return (v >= F.least(a, b) - EPS) & (v <= F.greatest(a, b) + EPS)


def _odd(ring: Polygon | Ring, x: Column, y: Column) -> Column:
    """Whether the line to the east of a point meets the ring an odd number of times."""
    east = lambda e: x < F.try_divide((e[2] - e[0]) * (y - e[1]), e[3] - e[1]) + e[0]
    return F.size(F.filter(_edges(ring), lambda e: ((e[1] > y) != (e[3] > y)) & east(e))) % 2 == 1


def _touched(g: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Whether an edge and a box aren't apart: by longitude, by latitude, or as all corners lie on one side of its line."""
    sides = F.array(_cross(g, w, s), _cross(g, e, s), _cross(g, e, n), _cross(g, w, n))
    near = (F.least(g[0], g[2]) <= e + EPS) & (F.greatest(g[0], g[2]) >= w - EPS)
    near = near & (F.least(g[1], g[3]) <= n + EPS) & (F.greatest(g[1], g[3]) >= s - EPS)
    return near & (F.array_min(sides) <= EPS) & (F.array_max(sides) >= -EPS)


def box_of(ring: Polygon | Ring) -> Box:
    return ring.box if isinstance(ring, Ring) else Box.of(*ring.bbox.edges)


def ring_contains(ring: Polygon | Ring, lon: Column, lat: Column) -> Column:
    """Inside the ring or on its edge."""
    ring = ring if isinstance(ring, Ring) else Ring.of(ring)

    def inside(p: Column) -> Column:
        x, y = p["x"], p["y"]
        on = F.exists(_edges(ring), lambda e: (F.abs(_cross(e, x, y)) <= EPS) & _between(e[0], e[2], x) & _between(e[1], e[3], y))
        return on | _odd(ring, x, y)

    return _let(F.struct(_near(lon, ring.first).alias("x"), lat.alias("y")), inside)


def ring_meets_box(ring: Polygon | Ring, b: Box) -> Column:
    """Whether the ring and a box share a point: an edge that meets the box, or a box within the ring."""
    ring = ring if isinstance(ring, Ring) else Ring.of(ring)
    west = _near(b.west, ring.middle)
    placed = F.struct(west.alias("w"), b.south.alias("s"), (west + lon_span(b)).alias("e"), b.north.alias("n"))

    def meets(r: Column) -> Column:
        w, s, e, n = r["w"], r["s"], r["e"], r["n"]
        return F.exists(_edges(ring), lambda g: _touched(g, w, s, e, n)) | _odd(ring, w, s)

    return _let(placed, meets)


def overlaps_area(area: BBox | Polygon | Ring, b: Box, kind: Column | None = None, lon: Column | None = None, lat: Column | None = None) -> Column:
    """The clip to an area that every source gets: a box by its edges; with a ring, point scenes by their point.

    The ring's box is tested first, so that the dear test runs on what passes the cheap one."""
    if isinstance(area, BBox):
        return intersects(b, Box.of(*area.edges))
    by_box = intersects(b, box_of(area)) & ring_meets_box(area, b)
    if kind is None:
        return by_box
    at_point = F.coalesce(contains(box_of(area), lon, lat) & ring_contains(area, lon, lat), F.lit(False))
    return F.when(kind == "point", at_point).otherwise(by_box)
