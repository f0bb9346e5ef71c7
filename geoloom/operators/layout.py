"""A table of scenes on disk whose scans read what a request needs: folders by month and size, rows in the order of a curve.

A scene's level is the finest whose cells (squares of 360 / 2 ** level degrees) are as large as its box, so that it lies in
the cell of its south-west corner and the next ones east and north. Rows of a month and level are written in the order of
that cell's place on the Z-order curve. A request's box, grown by a cell to the west and south, is a rectangle of cells at
each level; on the curve that is a few runs of numbers, which with months and times go to the scan as filters. The exact
test follows, so the runs need only hold the rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, lon_span
from geoloom.functions.rings import overlaps_area
from geoloom.functions.times import within_days
from geoloom.request import BBox, PullRequest

#: The finest level, and the runs of the curve that a request is turned into at most.
FINEST, RUNS = 16, 24
#: Masks that spread 32 bits over the even places of 64.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(v: Column) -> Column:
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve(x: Column, y: Column) -> Column:
    """The place of a cell on the Z-order curve."""
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1))


def placed(scenes: DataFrame) -> DataFrame:
    """scenes with month, level and cell."""
    b = Box.col()
    span = F.greatest(lon_span(b), b.north - b.south, F.lit(360.0 / 2**FINEST))
    level = F.floor(F.log2(F.lit(360.0) / span)).cast("int")
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    last = F.pow(F.lit(2.0), F.col("level")).cast("bigint") - 1
    at = lambda v: F.least(F.floor(v / side), last)
    return scenes.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("level", level).withColumn("cell", curve(at(b.west + 180), at(b.south + 90)))


def write(scenes: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Scenes with a time and a box, as a table for `search`. Ranges of (month, level, cell) go to one task each, so that
    files hold short stretches of the curve."""
    own = placed(scenes.filter("ts IS NOT NULL AND west IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL"))
    ranged = own.repartitionByRange("month", "level", "cell", "ts").sortWithinPartitions("month", "level", "cell", "ts")
    ranged.write.mode("append").partitionBy("month", "level").option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)


def runs(x0: int, x1: int, y0: int, y1: int, level: int, most: int = RUNS) -> list[tuple[int, int]]:
    """Runs of the curve, at most `most`, that hold all cells from (x0, y0) to (x1, y1) of a level: squares are cut in four
    while few enough stand."""
    square = [(level, 0, 0)]
    while True:
        cut, found = False, []
        for k, x, y in square:
            side = 1 << k
            if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
                continue
            within = x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1
            if within or k == 0:
                found.append((k, x, y))
                continue
            cut, half = True, side >> 1
            found += [(k - 1, x + i * half, y + j * half) for j in (0, 1) for i in (0, 1) if x + i * half <= x1 and x + (i + 1) * half > x0 and y + j * half <= y1 and y + (j + 1) * half > y0]
        spans: list[list[int]] = []
        for low, high in sorted((_z(x, y), _z(x, y) + (1 << 2 * k) - 1) for k, x, y in found):
            if spans and low <= spans[-1][1] + 1:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        if not cut or len(spans) > most:
            # The widest gaps stay; the others are read along.
            while len(spans) > most:
                i = min(range(len(spans) - 1), key=lambda j: spans[j + 1][0] - spans[j][1])
                spans[i : i + 2] = [[spans[i][0], spans[i + 1][1]]]
            return [tuple(s) for s in spans]
        square = found


def _z(x: int, y: int) -> int:
    return sum(((x >> i & 1) << 2 * i) | ((y >> i & 1) << 2 * i + 1) for i in range(32))


def reached(area: BBox, level: int) -> list[tuple[int, int]]:
    """Runs of the curve of a level in which scenes that meet a box have their cells."""
    side, turn = 360.0 / 2**level, 1 << level
    y0, y1 = max(0, int((area.south + 90) // side) - 1), min(turn - 1, int((area.north + 90) // side))
    found: list[tuple[int, int]] = []
    for part in area.parts:
        # One cell to the west, and round to the other end of the row where the globe closes.
        x0, x1 = int((part.west + 180) // side) - 1, min(turn - 1, int((part.east + 180) // side))
        found += runs(max(0, x0), x1, y0, y1, level)
        if x0 < 0:
            found += runs(turn - 1, turn - 1, y0, y1, level)
    return found


def search(spark: SparkSession, path: str, request: PullRequest) -> DataFrame:
    """The scenes of a written table that a request's days and area want."""
    table = spark.read.parquet(path)
    # Folder names alone answer this.
    levels = sorted(r["level"] for r in table.select("level").distinct().collect())
    days = within_days(F.col("ts"), str(request.start), str(request.end))
    months = (F.col("month").cast("string") >= f"{request.start:%Y-%m}") & (F.col("month").cast("string") <= f"{request.end:%Y-%m}")
    found = table.filter(F.lit(False))
    area = request.polygon or request.bbox
    for level in levels:
        near = F.lit(False)
        for low, high in reached(request.bbox, level):
            near = near | ((F.col("cell") >= low) & (F.col("cell") <= high))
        part = table.filter((F.col("level") == level) & months & days & near)
        kind = ("geometry_kind", "lon", "lat") if "geometry_kind" in table.columns else ()
        found = found.unionByName(part.filter(overlaps_area(area, Box.col(), *map(F.col, kind))))
    return found.drop("month", "level", "cell")
