"""Areas as a table against each ring by itself, and what their cells promise."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, rings
from geoloom.operators import areas as A
from geoloom.request import Polygon

SCENES = "ord long, west double, south double, east double, north double, geometry_kind string, lon double, lat double"


def wrapped(x):
    return x if -180 <= x <= 180 else (x + 180) % 360 - 180


def star(rnd, lon, lat, n, most):
    """A ring about a point, its corners nearer and further in turns."""
    turns = sorted(rnd.random() * 2 * math.pi for _ in range(n))
    out = [(wrapped(lon + math.cos(t) * (r := most * rnd.uniform(0.3, 1))), max(-89.0, min(89.0, lat + math.sin(t) * r))) for t in turns]
    return [*out, out[0]]


def made(seed):
    rnd = random.Random(seed)
    found = []
    while len(found) < 14:
        ring = star(rnd, rnd.choice([0, 90, 178, -179, 180]) + rnd.uniform(-3, 3), rnd.uniform(-60, 60), rnd.randrange(3, 40), rnd.choice([0.01, 1, 8, 30]))
        try:
            found.append((len(found), Polygon(tuple(ring))))
        except ValueError:
            continue
    scenes = []
    for i in range(1500):
        lon, lat = rnd.choice([0, 90, 178, -179, 180]) + rnd.uniform(-30, 30), rnd.uniform(-80, 80)
        size = rnd.choice([0.0, 0.001, 0.5, 6, 40])
        if i % 9 == 0:
            scenes.append((i, None, None, None, None, "point", wrapped(lon), lat) if i % 2 else (i, 0.0, 0.0, 0.0, 0.0, "point", wrapped(lon), lat))
        else:
            scenes.append((i, wrapped(lon), lat, wrapped(lon + size), min(90.0, lat + size), "bbox", None, None))
    # Boxes that end where others begin, on cells' edges and on the meridian.
    scenes += [(2000 + k, *e, "bbox", None, None) for k, e in enumerate([(-180.0, -90.0, 180.0, 90.0), (170.0, -5.0, 180.0, 5.0), (-180.0, -5.0, -170.0, 5.0), (180.0, 0.0, -180.0, 1.0), (0.0, 0.0, 11.25, 11.25), (90.0, 0.0, 90.0, 0.0)])]
    scenes.append((3000, None, None, None, None, "point", None, None))
    return found, scenes


@pytest.mark.parametrize("seed", [1, 2])
def test_many_areas_are_each_area(spark, seed):
    found, scenes = made(seed)
    s = spark.createDataFrame(scenes, SCENES)
    table = spark.createDataFrame([(i, [list(p) for p in ring.ring]) for i, ring in found], "area_id long, ring array<array<double>>")
    got = {tuple(r) for r in A.overlapping(A.ringed(table), s).collect()}
    each = s.select("ord", *[rings.overlaps_area(p, geo.Box.col(), F.col("geometry_kind"), F.col("lon"), F.col("lat")).alias(str(i)) for i, p in found])
    want = {(i, r["ord"]) for r in each.collect() for i, _ in found if r[str(i)]}
    assert got == want and len(want) > 100
    assert A.overlapping(A.ringed(table), s).count() == len(want)


def test_covers_hold_their_rings(spark):
    found, _ = made(3)
    table = A.ringed(spark.createDataFrame([(i, [list(p) for p in ring.ring]) for i, ring in found], "area_id long, ring array<array<double>>"))
    cells = table.select("area_id", F.inline(A.ring_cells(rings.Ring.stored())))
    placed = cells.select("area_id", "within", A._placed(F.col("level"), F.col("cell")).struct().alias("b")).collect()
    for i, ring in found:
        own = [r for r in placed if r.area_id == i]
        for x, y in ring.plane:
            x = wrapped(x)
            assert any(r.b.west - 1e-6 <= x <= r.b.east + 1e-6 and r.b.south - 1e-6 <= y <= r.b.north + 1e-6 for r in own)
        inner = sum((r.b.east - r.b.west) ** 2 for r in own if r.within)
        outer = sum((r.b.east - r.b.west) ** 2 for r in own)
        size = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring.plane, ring.plane[1:], strict=False))) / 2
        assert inner <= size + 1e-6 and size <= outer + 1e-6


def test_rings_that_are_none(spark):
    given = [(1, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]), (2, [[0.0, 80.0], [120.0, 80.0], [-120.0, 80.0], [0.0, 80.0]]), (3, [[0.0, 0.0], [1.0, 1.0], [2.0, 5.0], [3.0, 3.0]]), (4, [[0.0, 0.0]]), (5, None)]
    table = spark.createDataFrame(given, "area_id long, ring array<array<double>>")
    assert [r.area_id for r in A.ringed(table).collect()] == [1]
    assert A.overlapping(A.ringed(table.filter("area_id > 1")), spark.createDataFrame([], SCENES)).count() == 0


def test_no_loop_over_pairs(spark):
    found, scenes = made(4)
    table = A.ringed(spark.createDataFrame([(i, [list(p) for p in ring.ring]) for i, ring in found], "area_id long, ring array<array<double>>"))
    plan = A.overlapping(table, spark.createDataFrame(scenes, SCENES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pieces_of_rings(spark):
    table = spark.createDataFrame([(7, [[170.0, 0.0], [-170.0, 0.0], [-170.0, 10.0], [170.0, 10.0], [170.0, 0.0]])], "area_id long, ring array<array<double>>")
    got = A.split(table).select("piece", A.ring_area(F.col("ring")).alias("area"), F.array_max(F.transform("ring", lambda p: p[0])).alias("east")).collect()
    assert sorted((r.piece, r.area, r.east) for r in got) == [(0, 100.0, 180.0), (1, 100.0, -170.0)]
