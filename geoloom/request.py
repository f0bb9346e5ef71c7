"""What is asked for: a box or ring, dates and cloud bounds. Checked on the driver, then written into plans as literals."""

from __future__ import annotations

import datetime as dt
import json
import math
from dataclasses import dataclass
from functools import cached_property

#: Kinds of scene, and how a limit picks.
KINDS = "optical sar thermal lidar dem atmosphere browse detection altimetry precipitation landcover landsurface".split()
LIMIT_MODES = ("first", "last", "even")
MAX_VERTICES = 4096
EPS = 1e-9

Point = tuple[float, float]


@dataclass(frozen=True)
class BBox:
    """west > east crosses 180 degrees."""

    west: float
    south: float
    east: float
    north: float

    def __post_init__(self):
        if not (all(map(math.isfinite, self.edges)) and abs(self.west) <= 180 and abs(self.east) <= 180 and -90 <= self.south <= self.north <= 90):
            raise ValueError(f"no box: {self.edges}")

    @property
    def edges(self) -> tuple[float, float, float, float]:
        return self.west, self.south, self.east, self.north

    @property
    def span(self) -> float:
        return (self.east - self.west) % 360 if self.east < self.west else self.east - self.west

    @property
    def parts(self) -> list[BBox]:
        """The boxes without a crossing that cover this one."""
        if self.west <= self.east:
            return [self]
        halves = [(self.west, 180.0), (-180.0, self.east)]
        found = [BBox(w, self.south, e, self.north) for w, e in halves if w < e]
        if not found:
            raise ValueError("a box without width on either side of 180 degrees")
        return found

    @classmethod
    def enclosing(cls, points: list[Point]) -> BBox:
        """The circle without its widest gap; the gap across 180 degrees wins a tie."""
        lons = sorted(p[0] for p in points)
        lats = [p[1] for p in points]
        around = [(360 - (lons[-1] - lons[0]), lons[0], lons[-1])]
        around += [(b - a, b, a) for a, b in zip(lons, lons[1:], strict=False)]
        _, west, east = max(around, key=lambda g: g[0])
        return cls(west, min(lats), east, max(lats))


def unwrapped(ring: list[Point]) -> list[Point]:
    """The ring with longitudes that run on across 180 degrees; a ring about a pole is refused."""
    out = [ring[0]]
    for lon, lat in ring[1:]:
        out.append((lon - 360 * round((lon - out[-1][0]) / 360), lat))
    lons = [p[0] for p in out]
    if abs(lons[-1] - lons[0]) > 1e-6 or abs(out[-1][1] - out[0][1]) > 1e-6 or max(lons) - min(lons) >= 360:
        raise ValueError("a ring about a pole, or one that isn't closed")
    return out


def cross(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def signed_area(points: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:], strict=False)) / 2


def _sign(x: float) -> int:
    return (x > EPS) - (x < -EPS)


def _on(p: Point, a: Point, b: Point) -> bool:
    return all(min(a[k], b[k]) - EPS <= p[k] <= max(a[k], b[k]) + EPS for k in (0, 1))


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments share a point."""
    o = [_sign(cross(a, b, c)), _sign(cross(a, b, d)), _sign(cross(c, d, a)), _sign(cross(c, d, b))]
    touches = [(0, c, a, b), (1, d, a, b), (2, a, c, d), (3, b, c, d)]
    return any(o[i] == 0 and _on(p, q, r) for i, p, q, r in touches) or (o[0] * o[1] < 0 and o[2] * o[3] < 0)


def crosses_itself(points: list[Point]) -> bool:
    """Whether two edges that aren't neighbours meet. Edges in order of their west end: those that end before the
    next one begins are passed over."""
    n = len(points) - 1
    edges = sorted((min(points[i][0], points[i + 1][0]), max(points[i][0], points[i + 1][0]), i) for i in range(n))
    for k, (_, east, i) in enumerate(edges):
        for west, _, j in edges[k + 1 :]:
            if west > east + EPS:
                break
            if abs(i - j) not in (1, n - 1) and segments_meet(points[i], points[i + 1], points[j], points[j + 1]):
                return True
    return False


@dataclass(frozen=True)
class Polygon:
    """One closed ring without holes, counter-clockwise once made; a crossing of 180 degrees is allowed."""

    ring: tuple[Point, ...]

    def __post_init__(self):
        ring = [(float(x), float(y)) for x, y in self.ring]
        if not 4 <= len(ring) <= MAX_VERTICES or ring[0] != ring[-1]:
            raise ValueError("a ring is closed and has 4 to 4096 positions")
        if any(a == b for a, b in zip(ring, ring[1:], strict=False)):
            raise ValueError("an edge without length")
        if not all(math.isfinite(x) and math.isfinite(y) and abs(x) <= 180 and abs(y) <= 90 for x, y in ring):
            raise ValueError("a position off the globe")
        plane = unwrapped(ring)
        size = signed_area(plane)
        if abs(size) <= EPS or crosses_itself(plane):
            raise ValueError("a ring without area, or one that crosses itself")
        object.__setattr__(self, "ring", tuple(ring if size > 0 else ring[::-1]))

    @cached_property
    def plane(self) -> list[Point]:
        return unwrapped(list(self.ring))

    @cached_property
    def bbox(self) -> BBox:
        lons, lats = [p[0] for p in self.plane], [p[1] for p in self.plane]
        if max(lons) - min(lons) >= 360:
            return BBox(-180.0, min(lats), 180.0, max(lats))
        back = lambda x: x if -180 <= x <= 180 else (x + 180) % 360 - 180
        return BBox(back(min(lons)), min(lats), back(max(lons)), max(lats))

    @property
    def signature(self) -> tuple[Point, ...]:
        """The ring from its least position on: alike for all rotations of a ring."""
        body = list(self.ring[:-1])
        at = body.index(min(body))
        return tuple(body[at:] + body[:at])

    @property
    def pieces(self) -> list[list[Point]]:
        """Rings without a crossing that cover this one, cut at 180 degrees: one, or several west and east of it.

        The ring is cut by the meridian into chains; on each side, chains are closed along the meridian by linking
        their ends in pairs, in order of latitude."""
        lons = [p[0] for p in self.plane]
        meridian = 180.0 if max(lons) > 180 else -180.0 if min(lons) < -180 else None
        if meridian is None:
            return [list(self.plane)]
        found = []
        for keep in (-1, 1):
            # The side toward 0 stays; the other one is turned back by 360 degrees.
            shift = 0.0 if keep * meridian < 0 else -360.0 if meridian > 0 else 360.0
            found += [[(x + shift, y) for x, y in ring] for ring in _side(self.plane, meridian, keep)]
        return found


def _side(plane: list[Point], meridian: float, keep: int) -> list[list[Point]]:
    """Closed rings of what lies west (-1) or east (1) of a meridian."""
    body = plane[:-1]
    side = lambda p: _sign((p[0] - meridian) * keep)
    if all(side(p) <= 0 for p in body):
        return []
    start = next(i for i in range(len(body)) if side(body[i]) <= 0 < side(body[(i + 1) % len(body)]))
    order = body[start:] + body[:start] + [body[start]]
    chains: list[list[Point]] = []
    for a, b in zip(order, order[1:], strict=False):
        sa, sb = side(a), side(b)
        cut = a if sa == 0 else b if sb == 0 else (meridian, a[1] + (b[1] - a[1]) * (meridian - a[0]) / (b[0] - a[0] or 1.0))
        if sa <= 0 < sb:
            chains.append([(meridian, cut[1]), b])
        elif sa > 0 >= sb:
            chains[-1].append((meridian, cut[1]))
        elif sa > 0:
            chains[-1].append(b)
    # Along the meridian the ends, in order of latitude, pair up: between the two of a pair lies the inside.
    ends = sorted((c[k][1], i, k) for i, c in enumerate(chains) for k in (0, -1))
    partner = {}
    for (_, i, k), (_, j, m) in zip(ends[::2], ends[1::2], strict=True):
        partner[i, k], partner[j, m] = (j, m), (i, k)
    rings, seen = [], set()
    for first in range(len(chains)):
        ring, i = [], first
        while i not in seen:
            seen.add(i)
            ring += chains[i]
            i = partner[i, -1][0]
        if ring:
            rings.append(ring + [ring[0]])
    return rings


@dataclass(frozen=True)
class PullRequest:
    """Scenes of whole days from start to end, both inclusive, that meet the area."""

    start: dt.date
    end: dt.date
    bbox: BBox | None = None
    polygon: Polygon | None = None
    min_cloud: float | None = None
    max_cloud: float | None = None
    limit: int | None = None
    limit_mode: str | None = None

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError("the end lies before the start")
        for bound in (self.min_cloud, self.max_cloud):
            if bound is not None and not 0 <= bound <= 100:
                raise ValueError("a cloud bound is 0 to 100")
        if None not in (self.min_cloud, self.max_cloud) and self.max_cloud < self.min_cloud:
            raise ValueError("the cloud bounds leave nothing")
        if self.limit is not None and self.limit < 1 or self.limit_mode not in (None, *LIMIT_MODES):
            raise ValueError("a limit is 1 or more, its mode first, last or even")
        if self.bbox is None and self.polygon is None:
            raise ValueError("an area is asked for")
        if self.bbox is None:
            object.__setattr__(self, "bbox", self.polygon.bbox)


def parse_dates(text: str) -> tuple[dt.date, dt.date]:
    """`first:last` (or / or , between them) as two days in order."""
    for between in ":/,":
        first, found, last = text.strip().partition(between)
        if found:
            days = dt.date.fromisoformat(first.strip()), dt.date.fromisoformat(last.strip())
            if days[0] > days[1]:
                raise ValueError(f"{days[1]} lies before {days[0]}")
            return days
    raise ValueError("two days are wanted: first:last")


def parse_box(text: str) -> BBox:
    """`west,south,east,north` as a box that has an area."""
    edges = [float(x) for x in text.split(",")]
    if len(edges) != 4:
        raise ValueError("a box has four edges: west,south,east,north")
    box = BBox(*edges)
    if box.west == box.east or box.south == box.north:
        raise ValueError("a box without area")
    return box


def parse_polygon(text: str) -> Polygon:
    """A GeoJSON Polygon or a Feature of one, a JSON ring, or `lon,lat` pairs with semicolons between; closed if it is open."""
    try:
        given = json.loads(text)
    except ValueError:
        given = [[float(x) for x in pair.split(",")] for pair in text.split(";") if pair.strip()]
    if isinstance(given, dict) and given.get("type") == "Feature":
        given = given.get("geometry")
    if isinstance(given, dict):
        if given.get("type") != "Polygon" or len(given.get("coordinates") or []) != 1:
            raise ValueError("one ring without holes is wanted")
        given = given["coordinates"][0]
    if not isinstance(given, list) or not given or not all(isinstance(p, list) and len(p) >= 2 for p in given):
        raise ValueError("a ring of positions is wanted")
    ring = [(float(p[0]), float(p[1])) for p in given]
    return Polygon(tuple(ring if len(ring) > 1 and ring[0] == ring[-1] else [*ring, ring[0]]))


def parse_names(text: str) -> list[str]:
    """Names with commas between; blank ones are left out."""
    return [x for x in map(str.strip, text.split(",")) if x]
