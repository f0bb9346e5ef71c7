"""Longitude/latitude boxes as columns: all of it built-in expressions, so filters stay in generated code.

A box whose west is larger than its east crosses 180 degrees. The meridians +180 and -180 are distinct to
`contains`, as are the edges of the parts a crossing box is cut into.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres that one degree of latitude is taken for.
KM_PER_DEGREE = 111.32
#: Web Mercator's sphere and its largest latitude.
MERCATOR_RADIUS, MERCATOR_LATITUDE = 6378137.0, 85.05112878


class Box(NamedTuple):
    """The four edges of a box; columns, or literals by `Box.of`."""

    west: Column
    south: Column
    east: Column
    north: Column

    @classmethod
    def of(cls, west: float, south: float, east: float, north: float) -> Box:
        return cls(*(F.lit(float(x)) for x in (west, south, east, north)))

    @classmethod
    def col(cls, name: str = "") -> Box:
        """The columns west, south, east and north, or the fields of the struct column of that name."""
        return cls(*(F.col(f"{name}.{x}" if name else x) for x in cls._fields))

    def struct(self) -> Column:
        return F.struct(*[getattr(self, x).alias(x) for x in self._fields])


def lon_span(b: Box) -> Column:
    span = b.east - b.west
    return F.when(span < 0, span + 360.0).otherwise(span)


def contains(b: Box, lon: Column, lat: Column) -> Column:
    """Closed on all sides."""
    inside = F.when(b.west > b.east, (lon >= b.west) | (lon <= b.east)).otherwise((lon >= b.west) & (lon <= b.east))
    return (lat >= b.south) & (lat <= b.north) & inside


def _ranges(b: Box) -> list[tuple[Column, Column, Column]]:
    """(present, west, east) of the one or two runs of longitude without a crossing."""
    crossing = b.west > b.east
    return [(F.lit(True), b.west, F.when(crossing, F.lit(180.0)).otherwise(b.east)), (crossing, F.lit(-180.0), b.east)]


def intersects(a: Box, b: Box) -> Column:
    """True if the boxes share a point; a touch counts."""
    meets = F.lit(False)
    for here, west, east in _ranges(a):
        for there, w, e in _ranges(b):
            meets = meets | (here & there & (west <= e) & (w <= east))
    return (a.north >= b.south) & (b.north >= a.south) & meets


def area(b: Box) -> Column:
    """Square degrees."""
    height = b.north - b.south
    return F.when(height > 0, lon_span(b) * height).otherwise(F.lit(0.0))


def overlap_area(a: Box, b: Box) -> Column:
    height = F.least(a.north, b.north) - F.greatest(a.south, b.south)
    width = F.lit(0.0)
    for here, west, east in _ranges(a):
        for there, w, e in _ranges(b):
            both = F.least(east, e) - F.greatest(west, w)
            width = width + F.when(here & there & (both > 0), both).otherwise(F.lit(0.0))
    return F.when(height > 0, width * height).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for a mere touch, 1 for boxes that are alike."""
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(both <= 0, F.lit(0.0)).when(union <= both, F.lit(1.0)).otherwise(both / union)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Share of the smaller box that the other covers."""
    return F.try_divide(overlap_area(a, b), F.least(area(a), area(b)))


def parts(b: Box) -> Column:
    """The boxes without a crossing that cover a box: one or two, those of no width left out."""
    whole = F.array(b.struct())
    halves = F.array(Box(b.west, b.south, F.lit(180.0), b.north).struct(), Box(F.lit(-180.0), b.south, b.east, b.north).struct())
    return F.when(b.west <= b.east, whole).otherwise(F.filter(halves, lambda p: p["west"] < p["east"]))


def from_point(lon: Column, lat: Column, pad: float = 0.01) -> Box:
    return Box(
        F.greatest(F.lit(-180.0), lon - pad),
        F.greatest(F.lit(-90.0), lat - pad),
        F.least(F.lit(180.0), lon + pad),
        F.least(F.lit(90.0), lat + pad),
    )


def wrap_longitude(lon: Column) -> Column:
    """A longitude beyond 180 degrees either way, brought back."""
    return F.when((lon < -180.0) | (lon > 180.0), F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon)


def around(lon: Column, lat: Column, radius_km: Column) -> Box:
    """The box that holds a radius about a point; one that reaches a pole has every longitude."""
    pad = radius_km / KM_PER_DEGREE
    wide = pad / F.cos(F.radians(lat))
    whole = (lat - pad <= -90.0) | (lat + pad >= 90.0) | (wide >= 180.0)
    return Box(
        F.when(whole, F.lit(-180.0)).otherwise(wrap_longitude(lon - wide)),
        F.greatest(F.lit(-90.0), lat - pad),
        F.when(whole, F.lit(180.0)).otherwise(wrap_longitude(lon + wide)),
        F.least(F.lit(90.0), lat + pad),
    )


def centre(b: Box) -> tuple[Column, Column]:
    """The middle; that of a crossing box is taken across 180 degrees."""
    lon = b.west + lon_span(b) / 2
    return F.when(lon > 180, lon - 360).otherwise(lon), (b.south + b.north) / 2


def enclosing(lons: Column, lats: Column) -> Box:
    """The least box of arrays of points: the circle without its widest gap. The gap across 180 degrees wins a tie."""
    s = F.array_sort(lons)
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    gaps = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.struct((b - a).alias("gap"), (-b).alias("west"), a.alias("east")))
    # The first of equal gaps counts: the one with the smallest west, as they stand in order.
    widest = F.array_max(gaps)
    inner = widest["gap"] > 360.0 - (last - first)
    return Box(
        F.when(inner, -widest["west"]).otherwise(first),
        F.array_min(lats),
        F.when(inner, widest["east"]).otherwise(last),
        F.array_max(lats),
    )


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres."""
    kept = F.least(F.greatest(lat, F.lit(-MERCATOR_LATITUDE)), F.lit(MERCATOR_LATITUDE))
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(kept) / 2)) * MERCATOR_RADIUS


def utm(lon: Column, lat: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """WGS 84 transverse Mercator metres by the usual series to the sixth power of the angle from the zone's middle."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    nu = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t, c = F.pow(F.tan(phi), F.lit(2.0)), ep2 * F.pow(F.cos(phi), F.lit(2.0))
    d = F.cos(phi) * (F.radians(lon) - F.radians(zone * 6.0 - 183.0))
    # Length of the meridian from the equator: coefficients of the angle and of the sines of its multiples.
    arc = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
    for m, factor in (
        (2, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)),
        (4, 15 * e2**2 / 256 + 45 * e2**3 / 1024),
        (6, -35 * e2**3 / 3072),
    ):
        arc = arc + F.lit(factor) * F.sin(m * phi)
    p = lambda n: F.pow(d, F.lit(float(n)))
    east = d + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * p(5) / 120
    north = p(2) / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * p(6) / 720
    return (
        k0 * nu * east + 500_000.0,
        k0 * (a * arc + nu * F.tan(phi) * north) + F.when(northern, F.lit(0.0)).otherwise(F.lit(10_000_000.0)),
    )


def world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Place on the Web Mercator square, 0 to 1 from the north-west corner."""
    return (lon + 180.0) / 360.0, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy tile numbers, cut toward zero."""
    x, y = world(lon, lat)
    return (x * 2**zoom).cast("int"), (y * 2**zoom).cast("int")


def pixel(lon: Column, lat: Column, zoom: int, tile_px: int = 256) -> tuple[Column, Column]:
    x, y = world(lon, lat)
    return x * (tile_px * 2**zoom), y * (tile_px * 2**zoom)


def _snapped(value: Column) -> Column:
    near = F.bround(value)
    return F.when(F.abs(value - near) <= 1e-8, near).otherwise(value)


def pixel_window(b: Box, origin_x: Column, origin_y: Column, size_x: Column, size_y: Column, width: Column, height: Column) -> Column:
    """col0, row0, col1, row1 of the pixels that a box in model units meets; null if it meets none."""
    col0 = F.greatest(F.lit(0), F.floor(_snapped((b.west - origin_x) / size_x)).cast("int"))
    col1 = F.least(width, F.ceil(_snapped((b.east - origin_x) / size_x)).cast("int"))
    row0 = F.greatest(F.lit(0), F.floor(_snapped((origin_y - b.north) / size_y)).cast("int"))
    row1 = F.least(height, F.ceil(_snapped((origin_y - b.south) / size_y)).cast("int"))
    window = F.struct(col0.alias("col0"), row0.alias("row0"), col1.alias("col1"), row1.alias("row1"))
    some = (b.west < b.east) & (b.south < b.north) & (col1 > col0) & (row1 > row0)
    return F.when(some, window)


#: Earth and satellite of the geostationary projection (km), and the satellite's longitude.
EQUATOR, POLE, DISTANCE, SUB_LON = 6378.1370, 6356.7523, 42164.0, 140.7
#: Line factors by the number of full-disk lines, and segments of a disk.
LINE_FACTORS, SEGMENTS = {5500: 20466275, 11000: 40932549, 22000: 81865099}, 10


def disk_line(lon: Column, lat: Column, lines: int = 5500) -> Column:
    """Fractional line of the full disk (1 is north) that shows a point; null where the satellite doesn't see it."""
    flat = (POLE / EQUATOR) ** 2
    c = F.atan(F.lit(flat) * F.tan(F.radians(lat)))
    away = F.radians(lon - SUB_LON)
    r = F.lit(POLE) / F.sqrt(1 - (1 - flat) * F.cos(c) * F.cos(c))
    x = F.lit(DISTANCE) - r * F.cos(c) * F.cos(away)
    y, z = -r * F.cos(c) * F.sin(away), r * F.sin(c)
    seen = F.lit(DISTANCE) * (F.lit(DISTANCE) - x) - y * y - z * z / flat >= 0
    angle = F.degrees(F.asin(-z / F.sqrt(x * x + y * y + z * z)))
    line = F.lit(lines / 2 + 0.5) + angle * 2**-16 * LINE_FACTORS[lines]
    return F.when(seen & (line >= 1) & (line < lines + 1), line)


def segment(lon: Column, lat: Column, lines: int = 5500) -> Column:
    """The strip of the disk (1 is the northernmost of ten) that shows a point."""
    strip = F.floor((disk_line(lon, lat, lines) - 1) / (lines // SEGMENTS)) + 1
    return F.when(strip > SEGMENTS, SEGMENTS).otherwise(strip).cast("int")
