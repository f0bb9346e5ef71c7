"""Many areas against many scenes: quadtree cells of rings and boxes meet by an equal join.

Cells of level k are squares of 360 / 2 ** k degrees, counted from 180 west and 90 south. A ring is covered by cells that
lie within it and cells that its edge runs through; only the latter are cut further. A box lies in the one to four cells
of the level whose cells are as large as it is. A box's cell and a ring's cell meet if one holds the other: each side
also stands at the cells above its own, but never above the other's coarsest, and a pair of cells above meets nothing.

Where the box meets a cell within the ring, no ring is looked at; the other pairs are held against the ring, once each.
So are pairs as wide as WIDE degrees: the test against a ring takes a box at the one turn of the globe that is nearest,
which such a box may miss the ring in, and both ways have to agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import rings
from geoloom.functions.geo import Box, intersects, lon_span
from geoloom.functions.rings import Ring
from geoloom.request import EPS, Polygon
from geoloom.tables import cut, join_checked

#: The finest level, and how often a ring's edge cells are cut in four below the level of its box.
FINEST, STEPS = 20, 4
WIDE = 90.0
_CELL = "array<struct<level:int,x:bigint,y:bigint,within:boolean,edges:array<array<double>>>>"


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _level(span: Column) -> Column:
    """The finest level whose cells are as large as span."""
    return F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / F.greatest(span, F.lit(1e-9)))))).cast("int")


def _key(level: Column, x: Column, y: Column) -> Column:
    """One number of a cell; longitudes beyond 180 degrees come round."""
    turn = F.pow(F.lit(2.0), level).cast("bigint")
    return (level.cast("bigint") * (1 << (FINEST + 1)) + F.pmod(x, turn)) * (1 << (FINEST + 1)) + y


def _placed(level: Column, key: Column) -> Box:
    """The box of a cell, from its number."""
    side, m = _side(level), 1 << (FINEST + 1)
    west, south = F.pmod(F.floor(key / m), F.lit(m)) * side - 180, F.pmod(key, F.lit(m)) * side - 90
    return Box(west, south, west + side, south + side)


def ring_cells(ring: Ring, steps: int = STEPS) -> Column:
    """The cells (level, x, y, within) that cover each ring: those within it, and steps levels down those on its edge."""
    low = lambda k: F.array_min(F.transform(ring.edges, lambda e: F.least(e[k], e[k + 2])))
    high = lambda k: F.array_max(F.transform(ring.edges, lambda e: F.greatest(e[k], e[k + 2])))

    def judged(level: Column, x: Column, y: Column, edges: Column) -> Column:
        """A cell with the edges that run through it; of those of the cell above, as no other edge can."""
        side = _side(level)
        w, s = x * side - 180, y * side - 90
        own = F.filter(edges, lambda e: rings._touched(e, w, s, w + side, s + side))
        return F.struct(level.alias("level"), x.alias("x"), y.alias("y"), ((F.size(own) == 0) & rings._odd(ring, w, s)).alias("within"), own.alias("edges"))

    def first(b: Column) -> Column:
        level = _level(F.greatest(b["e"] - b["w"], b["n"] - b["s"]))
        side = _side(level)
        run = lambda a, z, off: F.sequence(F.floor((a - EPS + off) / side), F.floor((z + EPS + off) / side))
        return F.flatten(F.transform(run(b["w"], b["e"], 180), lambda x: F.transform(run(b["s"], b["n"], 90), lambda y: judged(level, x, y, ring.edges))))

    def finer(c: Column) -> Column:
        down = F.array(*[F.struct((c["x"] * 2 + i).alias("x"), (c["y"] * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)])
        return F.when(c["within"], F.array(c)).otherwise(F.transform(down, lambda d: judged(c["level"] + 1, d["x"], d["y"], c["edges"])))

    kept = lambda cells: F.filter(cells, lambda c: c["within"] | (F.size(c["edges"]) > 0))
    cells = kept(rings._let(F.struct(low(0).alias("w"), low(1).alias("s"), high(0).alias("e"), high(1).alias("n")), first).cast(_CELL))
    for _ in range(steps):
        cells = kept(F.flatten(F.transform(cells, finer)).cast(_CELL))
    return F.transform(cells, lambda c: F.struct(c["level"].alias("level"), _key(c["level"], c["x"], c["y"]).alias("cell"), c["within"].alias("within")))


def box_cells(b: Box) -> Column:
    """The cells (level, cell) of the level whose cells are as large as the box, or as its parts where it crosses 180 degrees."""

    def of(p: Column) -> Column:
        level = _level(F.greatest(p["east"] - p["west"], p["north"] - p["south"]) + 4 * EPS)
        side, last = _side(level), F.pow(F.lit(2.0), level).cast("bigint") - 1
        at = lambda v: F.floor(v / side)
        xs = F.sequence(F.greatest(at(p["west"] - EPS + 180), F.lit(0)), F.least(at(p["east"] + EPS + 180), last))
        ys = F.sequence(at(p["south"] - EPS + 90), at(p["north"] + EPS + 90))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(level.alias("level"), _key(level, x, y).alias("cell")))))

    # A box of no width on either side of 180 degrees stays whole, so that it has cells.
    halves = F.when(b.west <= b.east, F.array(b.struct())).otherwise(
        F.array(Box(b.west, b.south, F.lit(180.0), b.north).struct(), Box(F.lit(-180.0), b.south, b.east, b.north).struct())
    )
    return F.flatten(F.transform(halves, of))


def _above(level: Column, cell: Column, lowest: int) -> Column:
    """The cell's number at each coarser level down to lowest."""
    m = 1 << (FINEST + 1)
    x, y = F.pmod(F.floor(cell / m), F.lit(m)), F.pmod(cell, F.lit(m))
    up = lambda k: _key(k.cast("int"), F.floor(x / F.pow(F.lit(2.0), level - k)), F.floor(y / F.pow(F.lit(2.0), level - k)))
    return F.when(level > lowest, F.transform(F.sequence(F.lit(lowest), level - 1), up)).otherwise(F.array().cast("array<bigint>"))


def ringed(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """areas with the ring column (arrays of lon, lat) as the struct that `Ring.stored` reads; rings about a pole, or not
    closed, are left out."""
    plane = areas.withColumn("_plane", rings.unwrapped(F.col(ring))).filter("_plane IS NOT NULL")
    return plane.withColumn(ring, Ring.col(F.col("_plane")).struct()).drop("_plane")


def overlapping(areas: DataFrame, scenes: DataFrame, steps: int = STEPS) -> DataFrame:
    """(area_id, ord) of every scene that meets an area: by its point if it is one, else by its box.

    areas: area_id and ring as `ringed` gives them. scenes: ord, the edges of a box, geometry_kind, lon, lat."""
    point = (F.col("geometry_kind") == "point") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    spot = Box(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"))
    at = scenes.filter((F.col("geometry_kind") != "point") | point).select(
        "ord", F.when(point, spot.struct()).otherwise(Box.col().struct()).alias("box"), F.coalesce(point, F.lit(False)).alias("point")
    )
    mine = cut(at.select("ord", "box", "point", F.inline(box_cells(Box.col("box")))), "areas-boxes")
    narrow = lon_span(Ring.stored().box) < WIDE
    theirs = cut(areas.select("area_id", narrow.alias("narrow"), F.inline(ring_cells(Ring.stored(), steps))), "areas-cells")
    # Two numbers: the coarsest levels of either side.
    levels = [df.agg(F.min("level")).first()[0] for df in (mine, theirs)]
    if None in levels:
        return areas.sparkSession.createDataFrame([], "area_id bigint, ord bigint")
    struct = lambda c, how: F.struct(c.alias("cell"), F.lit(how).alias("how"))
    own, ups = F.array(struct(F.col("cell"), 0)), lambda how, lowest: F.transform(_above(F.col("level"), F.col("cell"), lowest), lambda c: struct(c, how))
    # how 0: a ring's cell and a box's cell or one above it; how 1: a cell above a ring's and a box's own.
    left = theirs.select("area_id", F.col("level").alias("ring_level"), F.col("cell").alias("ring_cell"), (F.col("within") & F.col("narrow")).alias("within"), F.inline(F.concat(own, ups(1, levels[0]))))
    right = mine.select("ord", "box", "point", F.inline(F.concat(own, ups(0, levels[1]), F.array(struct(F.col("cell"), 1)))))
    met = join_checked(right, left, ["cell", "how"])
    here = Box.col("box")
    met = met.filter(intersects(here, _grown(_placed(F.col("ring_level"), F.col("ring_cell")))))
    # Whether any of the cells that a pair meets in is within the ring, and so decides it.
    sure = F.col("within") & (lon_span(here) < WIDE) & intersects(here, _placed(F.col("ring_level"), F.col("ring_cell")))
    pairs = cut(met.groupBy("area_id", "ord").agg(F.bool_or(sure).alias("sure"), F.first("box").alias("box"), F.first("point").alias("point")), "areas-pairs")
    open_pairs = join_checked(pairs.filter(~F.col("sure")), areas.select("area_id", "ring"), ["area_id"], most=1_000)
    ring = Ring.stored()
    at_point = intersects(here, ring.box) & rings.ring_contains(ring, F.col("box.west"), F.col("box.south"))
    hit = F.when(F.col("point"), at_point).otherwise(rings.overlaps_area(ring, here))
    return pairs.filter("sure").select("area_id", "ord").union(open_pairs.filter(hit).select("area_id", "ord"))


def _grown(b: Box) -> Box:
    return Box(b.west - EPS, b.south - EPS, b.east + EPS, b.north + EPS)


def containing(areas: DataFrame, points: DataFrame, steps: int = STEPS) -> DataFrame:
    """(area_id, ord) of every point (ord, lon, lat) in an area or on its edge."""
    as_scenes = points.select("ord", *[F.lit(None).cast("double").alias(k) for k in Box._fields], F.lit("point").alias("geometry_kind"), "lon", "lat")
    return overlapping(areas, as_scenes, steps)


def split(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """area_id, piece, side and points of rings (arrays of lon, lat), cut at 180 degrees where they cross it."""

    def cut_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for area, given in zip(batch.column("area_id").to_pylist(), batch.column("_ring").to_pylist(), strict=True):
                polygon = Polygon(tuple(map(tuple, given)))
                for i, piece in enumerate(polygon.pieces):
                    rows.append({"area_id": area, "piece": i, "ring": [list(p) for p in piece]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("area_id", pa.int64()), ("piece", pa.int32()), ("ring", pa.list_(pa.list_(pa.float64())))]))

    return areas.select("area_id", F.col(ring).alias("_ring")).mapInArrow(cut_rings, "area_id bigint, piece int, ring array<array<double>>")


def ring_area(ring: Column) -> Column:
    """Square degrees within a closed ring (arrays of lon, lat)."""
    turns = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda a, b: a + b)) / 2
