"""Other payloads to scenes: CMR granules, fire CSV lines, file listings, day previews, catalog trees, grids as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, enclosing, from_point, intersects
from geoloom.functions.times import parsed
from geoloom.request import BBox, PullRequest
from geoloom.tables import once

# CMR granules.

_GRANULE = """struct<meta:struct<`concept-id`:string>,umm:struct<GranuleUR:string,
CloudCover:string,TemporalExtent:struct<RangeDateTime:struct<BeginningDateTime:string,EndingDateTime:string>,SingleDateTime:string>,
SpatialExtent:struct<HorizontalSpatialDomain:struct<Geometry:struct<
BoundingRectangles:array<struct<WestBoundingCoordinate:double,SouthBoundingCoordinate:double,EastBoundingCoordinate:double,NorthBoundingCoordinate:double>>,
GPolygons:array<struct<Boundary:struct<Points:array<struct<Longitude:double,Latitude:double>>>>>>>>,
Platforms:array<struct<ShortName:string,Instruments:array<struct<ShortName:string>>>>,
RelatedUrls:array<struct<URL:string,Type:string,Subtype:string,Description:string>>>>"""


def granules(items: DataFrame, source: str, short_name: str, kind: str, gsd_m: float | None) -> DataFrame:
    """Scenes of CMR granules (ord, item: JSON text): box from the first rectangle, else around all polygons' points."""
    g = F.col("_g")
    # What several columns below are made of is bound first, in two steps: the item, then its points.
    rows = once(items, "ord", F.from_json("item", _GRANULE).alias("_g"))
    points = F.flatten(F.transform(g["umm"]["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]["GPolygons"], lambda p: p["Boundary"]["Points"]))
    points = F.filter(points, lambda p: p["Longitude"].isNotNull() & p["Latitude"].isNotNull())
    rows = once(rows, "ord", "_g", F.array_sort(F.transform(points, lambda p: p["Longitude"])).alias("_lons"), F.transform(points, lambda p: p["Latitude"]).alias("_lats"))
    around = enclosing(F.col("_lons"), F.col("_lats"))
    rows = once(rows, "ord", "_g", F.when(F.size("_lons") > 0, around.struct()).alias("_around"))
    time = g["umm"]["TemporalExtent"]
    start, end = parsed(time["RangeDateTime"]["BeginningDateTime"]), parsed(time["RangeDateTime"]["EndingDateTime"])
    r = F.get(g["umm"]["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]["BoundingRectangles"], F.lit(0))
    rect = Box(*[r[f"{e}BoundingCoordinate"] for e in ("West", "South", "East", "North")])
    has = rect.west.isNotNull() & rect.south.isNotNull() & rect.east.isNotNull() & rect.north.isNotNull()
    some = F.col("_around").isNotNull()
    box = [F.when(has, a).otherwise(F.col("_around")[e]) for a, e in zip(rect, Box._fields, strict=True)]
    cloud = g["umm"]["CloudCover"].try_cast("double")
    first = F.get(g["umm"]["Platforms"], F.lit(0))


    def url(kind: str, word: str = "") -> Column:
        fits = F.filter(g["umm"]["RelatedUrls"], lambda u: (u["Type"] == kind) & u["URL"].startswith("https://") & F.upper(F.concat_ws(" ", u["Subtype"], u["URL"])).contains(word))
        return F.get(fits, F.lit(0))["URL"]

    out = once(
        rows,
        "ord",
        F.coalesce(F.nullif(g["meta"]["concept-id"], F.lit("")), g["umm"]["GranuleUR"]).alias("id"),
        F.lit(source).alias("source"),
        F.lit(short_name).alias("collection"),
        F.lit(kind).alias("kind"),
        F.coalesce(start, parsed(time["SingleDateTime"]), end).alias("ts"),
        start.alias("start_ts"),
        end.alias("end_ts"),
        *[b.alias(n) for b, n in zip(box, Box._fields, strict=True)],
        F.when(has, "bbox").when(some, "polygon").alias("geometry_kind"),
        F.lit(gsd_m).cast("double").alias("gsd_m"),
        F.coalesce(F.nullif(first["ShortName"], F.lit("")), F.lit("MODIS")).alias("platform"),
        F.nullif(F.get(first["Instruments"], F.lit(0))["ShortName"], F.lit("")).alias("instrument"),
        F.when(~F.isnan(cloud) & (F.abs(cloud) != float("inf")), cloud).alias("cloud"),
        url("GET DATA").alias("data_href"),
        url("GET RELATED VISUALIZATION").alias("browse_href"),
        url("USE SERVICE API", "OPENDAP").alias("grid_href"),
    )
    return out.filter(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("west").isNotNull() & F.col("south").isNotNull())


def cmr_params(request: PullRequest, short_name: str, version: str, kind: str, page_size: int) -> dict[str, str]:
    found = {
        "short_name": short_name, "version": version, "page_size": str(page_size), "bounding_box": ",".join(f"{x:g}" for x in request.bbox.edges),
        "temporal": f"{request.start}T00:00:00Z,{request.end}T23:59:59Z",
    }
    if kind in ("optical", "browse") and not (request.min_cloud is None and request.max_cloud is None):
        found["cloud_cover"] = f"{request.min_cloud or 0:g},{100 if request.max_cloud is None else request.max_cloud:g}"
    return found


def model_granules(items: DataFrame, short_name: str, request: PullRequest) -> DataFrame:
    """Granules of a gridded model: their grids alone are of use, read in place. A box across 180 degrees is refused, as a
    grid's window is one."""
    if request.bbox.west > request.bbox.east:
        raise ValueError("a gridded model takes no box across 180 degrees: ask for either side")
    found = granules(items, short_name.lower(), short_name, "landsurface", None)
    return found.withColumn("data_href", F.col("grid_href")).filter("data_href IS NOT NULL").drop("grid_href", "browse_href")


# Fire detections.

FIRES = "latitude string, longitude string, brightness string, scan string, track string, acq_date string, acq_time string, satellite string, instrument string, confidence string, version string, bright_2 string, frp string, daynight string"


def fires(lines: DataFrame, source: str, platform: str = "unknown", gsd_m: float = 375.0) -> DataFrame:
    """Point scenes of CSV lines (ord, line); lines without a place or time are dropped. Columns stay as they came."""
    c = F.from_csv("line", F.lit(FIRES))
    rows = lines.withColumn("_c", c)
    lat, lon = F.col("_c.latitude").try_cast("double"), F.col("_c.longitude").try_cast("double")
    raw = F.coalesce(F.nullif(F.col("_c.acq_time"), F.lit("")), F.lit("0"))
    hour = F.when(F.length(raw) < 4, F.lpad(raw, 4, "0")).otherwise(raw)
    ts = F.try_to_timestamp(F.concat(F.col("_c.acq_date"), hour), F.lit("yyyy-MM-ddHHmm"))
    box = from_point(lon, lat)
    out = once(
        rows,
        "ord",
        F.concat(F.lit(f"{source}:"), F.format_string("%.4f", lat), F.lit(":"), F.format_string("%.4f", lon), F.lit(":"), F.col("_c.acq_date"), F.lit("T"), hour).alias("id"),
        F.lit(source).alias("collection"),
        ts.alias("ts"),
        *[b.alias(n) for b, n in zip(box, Box._fields, strict=True)],
        lon.alias("lon"),
        lat.alias("lat"),
        F.lit(gsd_m).alias("gsd_m"),
        F.coalesce(F.nullif(F.col("_c.satellite"), F.lit("")), F.lit(platform)).alias("platform"),
        F.col("_c.frp").try_cast("double").alias("frp"),
        F.col("_c.confidence").alias("confidence"),
    )
    return out.filter(F.col("ts").isNotNull() & lat_ok() & lon_ok())


def lat_ok() -> Column:
    return F.coalesce(F.col("lat").between(-90, 90), F.lit(False))


def lon_ok() -> Column:
    return F.coalesce(F.col("lon").between(-180, 180), F.lit(False))


def detections_table(found: DataFrame) -> DataFrame:
    """Rows as they are written: in order of time, place and id, empty text for null."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in found.columns if c != "ts"]
    return found.orderBy("ts", "lat", "lon", "id").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), *text)


# Listings of files.


def s3_listing(pages: DataFrame) -> DataFrame:
    """keys and prefixes of ListObjectsV2 pages (value: XML); a page that isn't well-formed has none."""
    plain = F.regexp_replace("value", r'\sxmlns="[^"]*"', "")
    ok = plain.rlike(r"(?s)<ListBucketResult.*</ListBucketResult>\s*$")
    doc = F.when(ok, plain).otherwise(F.lit("<ListBucketResult/>"))
    keys = F.xpath(doc, F.lit("/ListBucketResult/Contents/Key/text()"))
    prefixes = F.xpath(doc, F.lit("/ListBucketResult/CommonPrefixes/Prefix/text()"))
    return pages.select(*[c for c in pages.columns if c != "value"], keys.alias("keys"), prefixes.alias("prefixes"))


def goes(keys: DataFrame, bucket: str, side: str, product: str) -> DataFrame:
    """Scenes of file keys (ord, key) by the start in their name: year, day of year, time."""
    part = lambda i: F.regexp_extract("key", r"_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})", i).try_cast("int")
    ok = part(2).between(1, 366) & (part(3) < 24) & (part(4) < 60) & (part(5) < 60)
    ts = F.make_timestamp(part(1), F.lit(1), F.lit(1), part(3), part(4), part(5).cast("decimal(18,6)")) + F.make_dt_interval(part(2) - 1)
    return keys.filter(F.coalesce(ok, F.lit(False))).select(
        "ord", F.substring_index("key", "/", -1).alias("id"), F.lit(product).alias("collection"), ts.alias("ts"),
        F.lit("GOES-East" if side == "east" else "GOES-West").alias("platform"), F.concat(F.lit(f"https://{bucket}.s3.amazonaws.com/"), "key").alias("href"),
    )


def himawari(keys: DataFrame) -> DataFrame:
    """One scene a slot of file keys: its files by band and segment, in order of their names."""
    part = lambda i: F.regexp_extract("key", r"HS_H09_(\d{8})_(\d{4})_(B\d{2})_FLDK_R\d{2}_(S\d{4})", i)
    rows = keys.select("key", part(1).alias("day"), part(2).alias("slot"), F.concat(part(3), F.lit("_"), part(4)).alias("asset")).filter("day <> ''")
    ts = F.try_to_timestamp(F.concat("day", "slot"), F.lit("yyyyMMddHHmm"))
    g = rows.withColumn("ts", ts).filter(F.col("ts").isNotNull()).groupBy("ts")
    return g.agg(F.array_sort(F.collect_set(F.struct("asset", "key"))).alias("files")).select(
        F.concat(F.lit("HS_H09_"), F.date_format("ts", "yyyyMMdd_HHmm")).alias("id"), "ts", F.map_from_entries("files").alias("assets")
    )


# Day previews.

MOST_WIDTH, PREVIEW = 4096, 512


def preview_sizes(parts: list[BBox], size: int = PREVIEW) -> list[tuple[int, int]]:
    """Width and height of each part: degrees a pixel alike, all widths within MOST_WIDTH."""
    high, spans = parts[0].north - parts[0].south, [p.span for p in parts]
    size = max(1, size)
    if high <= 0 or sum(spans) <= 0:
        return [(size, size) for _ in parts]
    scale = min(1.0, MOST_WIDTH / (size * sum(spans) / high))
    return [(max(1, round(size * s / high * scale)), max(1, round(size * scale))) for s in spans]


def previews(spark: SparkSession, request: PullRequest, layer: str, host: str = "https://gibs.example/wms.cgi", size: int = PREVIEW) -> DataFrame:
    """A scene for every day and side of 180 degrees; the limit counts days. What they show is as large as was asked."""
    parts = request.bbox.parts
    split = len(parts) > 1 or request.bbox.west > request.bbox.east
    sides = [
        (i, *map(float, p.edges), w, h, ("east" if p.east == 180 else "west") if split else None)
        for i, (p, (w, h)) in enumerate(zip(parts, preview_sizes(parts, size), strict=True))
    ]
    n = (request.end - request.start).days + 1
    days = spark.range(min(n, request.limit or n)).select(F.date_add(F.lit(request.start), F.col("id").cast("int")).alias("day"))
    table = spark.createDataFrame(sides, "part int, west double, south double, east double, north double, width int, height int, side string")
    both = days.crossJoin(F.broadcast(table))  # one or two literal rows
    num = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"0{1,5}$", "")
    box = F.concat_ws("%2C", num("south"), num("west"), num("north"), num("east"))
    day = F.date_format("day", "yyyy-MM-dd")
    href = F.concat(
        F.lit(f"{host}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS={layer}&TIME="), day, F.lit("&CRS=EPSG%3A4326&BBOX="), box,
        F.lit("&WIDTH="), F.col("width").cast("string"), F.lit("&HEIGHT="), F.col("height").cast("string"), F.lit("&FORMAT=image%2Fpng&TRANSPARENT=TRUE"),
    )
    return both.select(
        F.concat_ws(":", F.lit(layer), day, "side").alias("id"), F.col("day").cast("timestamp").alias("ts"), "west", "south", "east", "north", "width", "height", href.alias("href"), F.lit(True).alias("footprint_is_request")
    )


# A static catalog tree.


def tree_items(events: DataFrame, acquisitions: DataFrame, items: DataFrame, request: PullRequest, most_events: int = 40) -> DataFrame:
    """Items of a three-level catalog (each level: id, parent, edges, first, last; items have ts) that meet a request.

    A node's declared extent prunes what hangs below it; one that is unknown lets through. most_events: the events that
    are looked into, by id, as the catalog's own walk does."""
    area = Box.of(*request.bbox.edges)

    def may_hold(df: DataFrame) -> DataFrame:
        b = Box.col()
        placed = F.coalesce(intersects(b, area), F.lit(True))
        timed = (F.col("first").isNull() | (F.col("first") <= F.lit(request.end))) & (F.col("last").isNull() | (F.col("last") >= F.lit(request.start)))
        return df.filter(placed & timed)

    roots = may_hold(events).orderBy("id").limit(most_events).select(F.col("id").alias("parent"))
    inner = may_hold(acquisitions).join(roots, "parent", "left_semi").select(F.col("id").alias("parent"))
    day = F.col("ts").cast("date")
    return items.join(inner, "parent", "left_semi").filter(intersects(Box.col(), area) & day.between(F.lit(request.start), F.lit(request.end)))


# Grids as text.

FILL = -9999.0


def _numbers(text: Column) -> Column:
    """The cells of a line, each behind its index in brackets if it has one: as numbers, null what is none; none empty."""
    cells = F.transform(F.split(text, r"[,\s]+"), lambda x: F.substring_index(x, "]", -1))
    return F.transform(F.filter(cells, lambda x: x != ""), lambda x: F.when(x.rlike("^[-+.0-9eE]+$"), x.try_cast("double")))


def _array_name(said: Column) -> Column:
    """`a.a` is the array a itself; `a.b` is b, an axis of a, and keeps its whole name."""
    parts = F.split(said, r"\.")
    return F.when((F.size(parts) == 2) & (parts[0] == parts[1]), parts[0]).otherwise(said)


def grids(files: DataFrame) -> DataFrame:
    """file, name, dims, values of the arrays in OPeNDAP answers (file, text); of two of one name the longer.

    A classic answer heads each array with `name[d0][d1]`, and the lines of numbers below are its values; any other line
    ends it. A gateway's answer begins a line with `Dataset:` and has a line for each row of an array,
    `name[place], v, v`, and for each axis, `X, v, v`. Rows of unlike lengths are no array. Lines are told apart by
    columns alone and ordered within their file."""
    text = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    gateway = F.exists(text, lambda x: F.ltrim(x).startswith("Dataset:"))
    line = files.select("file", gateway.alias("gateway"), F.posexplode(text).alias("at", "said")).withColumn("said", F.trim(F.translate("said", "\t", " ")))
    before, behind = F.substring_index("said", "[", 1), F.expr("substr(said, instr(said, '[') + 1)")
    named = before.rlike(r"^[A-Za-z_][\w.]*$")
    return _classic(line, before, behind, named).unionByName(_gateway(line))


def _classic(line: DataFrame, before: Column, behind: Column, named: Column) -> DataFrame:
    bare = F.rtrim(F.regexp_replace(behind, r"\s*;$", ""))
    dims = F.transform(F.split(F.regexp_replace(bare, r"\]$", ""), r"\]\["), lambda x: x.try_cast("int"))
    heads = F.col("said").contains("[") & named & bare.endswith("]") & F.forall(dims, lambda d: F.coalesce(d >= 0, F.lit(False)))
    own = line.filter("NOT gateway AND said <> ''").select(
        "file", "at", F.when(heads, before).alias("head"), F.when(heads, dims).alias("dims"), F.when(~heads, _numbers(F.col("said"))).alias("v")
    )
    plain = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    own = own.withColumn("ends", F.when(plain, 0).otherwise(1))
    block = F.sum("ends").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    values = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("ends") == 0, F.struct("at", "v")))), lambda x: x["v"]))
    arrays = own.withColumn("block", block).groupBy("file", "block").agg(F.max("head").alias("head"), F.max("dims").alias("dims"), values.alias("values"))
    return _longest(arrays.filter("head IS NOT NULL").select("file", _array_name(F.col("head")).alias("name"), "dims", "values", F.col("block").alias("at")))


def _gateway(line: DataFrame) -> DataFrame:
    first, rest = F.substring_index("said", ",", 1), F.expr("substr(said, instr(said, ',') + 1)")
    name, row = F.substring_index(first, "[", 1), first.contains("[")
    v = F.filter(_numbers(rest), lambda x: x.isNotNull())
    own = line.filter(F.col("gateway") & F.col("said").contains(",") & name.rlike(r"^[A-Za-z_][\w.]*$")).select("file", "at", name.alias("said"), row.alias("row"), v.alias("v")).filter(F.size("v") > 0)
    rows = own.filter("row").groupBy("file", _array_name(F.col("said")).alias("name")).agg(
        F.array_sort(F.collect_list(F.struct("at", "v"))).alias("lines"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")
    )
    rows = rows.filter("least = most").select(
        "file", "name", F.array(F.lit(1), F.size("lines"), F.col("most")).alias("dims"), F.flatten(F.transform("lines", lambda x: x["v"])).alias("values")
    )
    axis = F.substring_index("said", ".", -1)
    axes = own.filter(~F.col("row") & axis.isin("X", "Y")).select("file", axis.alias("name"), F.array(F.size("v")).alias("dims"), F.col("v").alias("values"), "at")
    return rows.unionByName(_longest(axes).join(rows.select("file", "name"), ["file", "name"], "left_anti"))


def _longest(arrays: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("dims", "values"), F.struct(F.size("values"), -F.col("at"))).alias("b")
    return arrays.groupBy("file", "name").agg(best).select("file", "name", "b.dims", "b.values")


def grid_cells(arrays: DataFrame, names: list[str], fill: float = FILL) -> DataFrame:
    """file, x, y (places in the grid) and a column for each variable; the fill value is null."""
    own = arrays.filter(F.col("name").isin(names)).select("file", "name", F.element_at("dims", -1).alias("nx"), F.posexplode("values").alias("i", "v"))
    value = lambda n: F.max(F.when((F.col("name") == n) & (F.col("v") != fill), F.col("v"))).alias(n)
    return own.groupBy("file", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x")).agg(*map(value, names))


def nearest_index(value: Column, first: float, step: float, n: int) -> Column:
    """The place of the nearest cell; null beyond half a cell outside the grid."""
    at = F.least(F.greatest(F.bround((value - first) / step), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    return F.when(F.abs(value - (first + at * step)) <= abs(step) / 2 + 1e-6, at)


def axis(first: float, last: float, n: int) -> list[float]:
    """The n centres of a regular axis, rebuilt from its ends to five decimals."""
    if n == 1:
        return [round(first, 5)]
    return [round(first + (last - first) * i / (n - 1), 5) for i in range(n)]


def cell_window(low: float, high: float, first: float, step: float, n: int) -> tuple[int, int]:
    """The inclusive places of the cells whose centres lie within bounds."""
    a, b = sorted(((low - first) / step, (high - first) / step))
    lo, hi = max(0, math.ceil(a - 1e-9)), min(n - 1, math.floor(b + 1e-9))
    if lo > hi:
        raise ValueError("no cell centre lies in the area")
    return lo, hi


def cells_within(cells: DataFrame, request: PullRequest, grid: tuple[float, float, int, float, float, int]) -> DataFrame:
    """Cells (x, y, ...) whose centres lie in the request's box; a box across 180 degrees is refused, as one window can't
    hold it."""
    if request.bbox.west > request.bbox.east:
        raise ValueError("a grid takes no box across 180 degrees: ask for either side")
    x0, dx, nx, y0, dy, ny = grid
    west, south, east, north = request.bbox.edges
    x, y = cell_window(west, east, x0, dx, nx), cell_window(south, north, y0, dy, ny)
    return cells.filter(F.col("x").between(*x) & F.col("y").between(*y))


def training_table(cells: DataFrame, points: DataFrame, grid: tuple[float, float, int, float, float, int], names: list[str]) -> DataFrame:
    """longitude, latitude, cell centre, time and variables of every point (lon, lat) in every month (cells: time, x, y, names).

    The nearest cell follows by arithmetic, so points meet cells in an equal join."""
    x0, dx, nx, y0, dy, ny = grid
    placed = points.select("lon", "lat", nearest_index(F.col("lon"), x0, dx, nx).alias("x"), nearest_index(F.col("lat"), y0, dy, ny).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    return placed.join(cells, ["x", "y"]).select(
        F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), (x0 + F.col("x") * dx).alias("cell_longitude"), (y0 + F.col("y") * dy).alias("cell_latitude"), "time", *names
    )


def points_table(lines: DataFrame) -> DataFrame:
    """lon, lat of CSV lines (line_no from 0, line): the columns are found by their names in the header, in any case, behind
    a byte-order mark or not; lines without two finite numbers are left out."""
    lons, lats = ("lon", "longitude", "long", "x"), ("lat", "latitude", "y")
    names = F.transform(F.split(F.regexp_replace("line", "^﻿", ""), ","), lambda x: F.lower(F.trim(x)))
    place = lambda wanted: F.coalesce(*[F.nullif(F.array_position(names, w), F.lit(0)) for w in wanted])
    head = lines.filter("line_no = 0").select(place(lons).cast("int").alias("a"), place(lats).cast("int").alias("b"))
    rows = lines.filter("line_no > 0 AND trim(line) <> ''").crossJoin(F.broadcast(head))  # the one header line
    cell = lambda c: F.trim(F.try_element_at(F.split("line", ",", -1), F.col(c))).try_cast("double")
    out = rows.select("line_no", cell("a").alias("lon"), cell("b").alias("lat"))
    return out.filter("NOT isnan(lon) AND NOT isnan(lat)").filter(lon_ok() & lat_ok())


