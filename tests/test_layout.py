"""Searches of the written table against the same without it, and what their scans read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import rings, times
from geoloom.functions.geo import Box
from geoloom.operators import layout as L
from geoloom.request import BBox, Polygon, PullRequest

SCHEMA = "ord long, ts timestamp_ntz, west double, south double, east double, north double, geometry_kind string, lon double, lat double"
SPANS = (dt.date(2024, 2, 10), dt.date(2024, 4, 5))
AREAS = [BBox(10.0, 5.0, 25.0, 20.0), BBox(170.0, -10.0, -175.0, 10.0), BBox(-180.0, -90.0, 180.0, 90.0), BBox(-180.0, -5.0, -179.0, 5.0), Polygon(((10.0, 5.0), (40.0, 5.0), (20.0, 30.0), (10.0, 5.0)))]


def wrapped(x):
    return x - 360 if x > 180 else x


@pytest.fixture(scope="module")
def scenes(spark):
    rnd, rows = random.Random(2), []
    for i in range(6000):
        west, south, size = rnd.choice([rnd.uniform(-180, 180), rnd.uniform(170, 180)]), rnd.uniform(-90, 80), rnd.choice([0.0, 0.01, 1.1, 9.0])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(60 * 24 * 180))
        point = i % 17 == 0
        rows.append((i, ts, west, south, wrapped(west + size), min(90.0, south + size), "point" if point else "bbox", west if point else None, south if point else None))
    rows += [(7000, dt.datetime(2024, 3, 1), 180.0, 0.0, 180.0, 0.0, "bbox", None, None), (7001, dt.datetime(2024, 3, 1), -180.0, -90.0, 180.0, 90.0, "bbox", None, None), (7002, None, 0.0, 0.0, 1.0, 1.0, "bbox", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def path(scenes, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("scenes") / "table")
    L.write(scenes, at, per_file=20)
    return at


@pytest.mark.parametrize("area", AREAS, ids=range(len(AREAS)))
def test_same_as_without(spark, scenes, path, area):
    request = PullRequest(*SPANS, **({"polygon": area} if isinstance(area, Polygon) else {"bbox": area}))
    want = scenes.filter(times.within_days(F.col("ts"), *map(str, SPANS)) & rings.overlaps_area(area, Box.col(), F.col("geometry_kind"), F.col("lon"), F.col("lat")))
    got = L.search(spark, path, request)
    assert got.columns == scenes.columns
    assert sorted(r.ord for r in got.collect()) == sorted(r.ord for r in want.collect())


def test_scans_read_less(spark, scenes, path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        got = L.search(spark, path, PullRequest(*SPANS, bbox=AREAS[0]))
        text = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in text.split("\n") if "FileScan" in x)
    parts, pushed = scan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "month" in parts and "level" in parts and "GreaterThanOrEqual(cell" in pushed and "GreaterThanOrEqual(ts" in pushed
    rows = [leaf.metrics().apply("numOutputRows").value() for leaf in _scans(got)]
    files = {r[0] for r in got.select(F.input_file_name()).distinct().collect()}
    assert 0 < sum(rows) < 0.15 * scenes.count()
    assert 0 < len(files) < 0.2 * len(spark.read.parquet(path).inputFiles())


def _scans(df):
    """The scans of a query's plan, once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return [x for x in (leaves.apply(i) for i in range(leaves.size())) if "FileScan" in x.toString()]


def test_runs_hold_their_cells():
    rnd = random.Random(1)
    for _ in range(200):
        k = rnd.randrange(0, 9)
        x0, x1 = sorted(rnd.randrange(1 << k) for _ in range(2))
        y0, y1 = sorted(rnd.randrange(1 << k) for _ in range(2))
        found = L.runs(x0, x1, y0, y1, k)
        cells = {L._z(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
        assert len(found) <= L.RUNS and all(any(a <= z <= b for a, b in found) for z in cells)
