"""Queries of the scalar functions: geometry, projections, dates, strings; each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from geoloom.functions import geo, text, times
from geoloom.operators import ranges, scenes
from geoloom.plans.views import oracle, view
from geoloom.sources import listings
from geoloom.tables import read



#: Endings of files that are taken as they are, and of packed ones.
RASTERS, PACKED = [".tif", ".jp2", ".nc", ".hdf", ".h5", ".zip", ".las", ".laz", ".png", ".jpg", ".gif", ".webp"], [".bz2", ".gz"]


def _b() -> geo.Box:
    return geo.Box.col()


def _area() -> geo.Box:
    return geo.Box.of(150, -45, -140, 45)


SPAN = "CASE WHEN east < west THEN east - west + 360 ELSE east - west END"


def _over(names: str, *columns, where: str | None = None):
    """A query of columns, made of functions of the view's columns."""

    def query(spark, sf_dir):
        rows = view(spark, sf_dir, names)
        rows = rows.filter(where) if where else rows
        return rows.select(*[c() if callable(c) else c for c in columns])

    return query


def g02_parts(spark, sf_dir):
    return view(spark, sf_dir, "scenes").select("ord", F.explode(geo.parts(_b())).alias("p")).select("ord", "p.west", "p.south", "p.east", "p.north")


def a21_enclosing(spark, sf_dir):
    return scenes.enclosing_boxes(view(spark, sf_dir, "detections"), ["user_id", "satellite"])


def g19_model_bounds(spark, sf_dir):
    """Bounds in metres of the nine sample points of each box."""
    s = view(spark, sf_dir, "scenes").filter("west <= east")
    shares = spark.createDataFrame([(i / 2, j / 2) for i in range(3) for j in range(3)], "fx double, fy double")
    # Nine literal rows.
    points = s.crossJoin(F.broadcast(shares))
    x, y = geo.mercator(_b().west + (_b().east - _b().west) * F.col("fx"), _b().south + (_b().north - _b().south) * F.col("fy"))
    out = points.withColumn("x", x).withColumn("y", y).groupBy("ord").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    return out.select("ord", *[F.round(f"{n}_{c}", 3).alias(f"{n}_{c}") for c in "xy" for n in ("min", "max")])


def g21_coalesced_ranges(spark, sf_dir):
    """Byte spans whose gap is at most 8192 as one span each, across blocks of places."""
    return ranges.coalesced(_spans(spark, sf_dir), ["file"], most=None, block=1 << 22)


def g21_capped_reads(spark, sf_dir):
    """The same in reads of no more than 8 MiB."""
    return ranges.coalesced(_spans(spark, sf_dir), ["file"], gap=1 << 16)


def _spans(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("file"), (F.col("l_orderkey") * 9973 % 40000000).alias("start")).withColumn("stop", F.col("start") + 1000 + F.col("start") % 3000)


def g21_tile_range(spark, sf_dir):
    """The tiles of 256 pixels that windows along a line of 10,000 need."""
    a = F.col("event_id") * 37 % 12000 - 1000
    d = view(spark, sf_dir, "detections").select("event_id", ranges.tiles_of(a, a + F.col("event_id") % 700, 256, F.lit(10000)).alias("t"))
    return d.filter("t IS NOT NULL").select("event_id", "t.first", "t.last")


def d03_day_list(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").select("ord", F.col("ts").cast("date").alias("start"))
    return s.select("ord", F.explode(times.days(F.col("start"), F.date_add("start", (F.col("ord") % 7).cast("int")))).alias("day")).select(
        "ord", "day", F.dayofyear("day").alias("doy")
    )


def d05_backward_chunks(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").select("ord", F.col("ts").cast("date").alias("start"))
    return s.select("ord", F.explode(times.chunks_backward(F.col("start"), F.date_add("start", (F.col("ord") % 37).cast("int")))).alias("c")).select(
        "ord", "c.first", "c.last"
    )


def d06_interval_overlap(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").select(
        "ord",
        F.when(F.col("ord") % 4 != 0, F.col("ts").cast("date")).alias("a"),
        F.when(F.col("ord") % 3 != 0, F.date_add(F.col("ts").cast("date"), 40)).alias("b"),
    )
    return s.filter(times.overlap(F.col("a"), F.col("b"), F.lit(dt.date(1995, 3, 1)), F.lit(dt.date(1995, 3, 31)))).select("ord")


def f11_finished_hours(spark, sf_dir):
    """Hours of a day's events that lie wholly before a given instant."""
    now = F.lit("2024-01-20 12:30:00").cast("timestamp_ntz")
    hours = view(spark, sf_dir, "detections").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return hours.filter(times.finished(F.col("hour"), now)).groupBy("hour").agg(F.count("*").alias("n"))


def f12_settled(spark, sf_dir):
    now = F.lit("2024-01-20 12:30:00").cast("timestamp_ntz")
    return view(spark, sf_dir, "detections").filter(times.settled(F.col("ts"), now, 3)).groupBy("satellite").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))


def _pages_text():
    link = F.concat(F.lit("GET "), F.col("url"), F.lit("?token=abc"), F.col("page_id").cast("string"), F.lit("#frag failed; api_key=K"), F.col("page_id").cast("string"), F.lit(" Bearer zz"), F.col("page_id").cast("string"), F.lit(" end"))
    return link


def s01_redacted(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.redacted(_pages_text()).alias("said"))


def s02_scrubbed_key(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    raw = F.concat(F.lit("https://firms.example/api/area/csv/KEY"), F.col("page_id").cast("string"), F.lit("/VIIRS_SNPP_NRT/1,2,3,4/1"))
    return p.select("page_id", text.redacted(raw).alias("said"))


def s06_asset_suffix(spark, sf_dir):
    a = view(spark, sf_dir, "assets")
    media = F.when(F.col("ord") % 3 == 0, F.col("media_type")).when(F.col("ord") % 3 == 1, "application/octet-stream")
    end = F.element_at(F.array(*map(F.lit, ("a.TIFF", "b.jpeg?x=1.png", "c.DAT.bz2", "d.zip", "e", "f.nc#g", "h.xyz", ".tif"))), (F.col("ord") % 8 + 1).cast("int"))
    return a.select("ord", text.asset_suffix(media, F.concat(F.lit("https://e.com/p.q/"), end), RASTERS, PACKED).alias("suffix"))


def s11_error_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    said = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("  failed\n at "), F.col("url"), F.lit("?key=v")))
    return p.select("page_id", text.error_text(F.lit("ReadTimeout"), said).alias("said"))


def s12_without_controls(spark, sf_dir):
    d = read(spark, sf_dir, "conversations")
    dirty = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\x07‮"))
    return d.select("conv_id", "turn", F.md5(text.without_controls(dirty).cast("binary")).alias("digest"))


def s13_compacted(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.compacted(F.col("text")).cast("binary")).alias("digest"), F.length(text.compacted(F.col("text"))).alias("n"))


def s14_truncated(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(text.truncated(F.col("text"), 1000)).alias("n"), F.md5(text.truncated(F.col("text"), 1000).cast("binary")).alias("digest"))


def f24_signed_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    keys = F.element_at(F.array(*map(F.lit, ["page", "SIG", "x-amz-date", "q", "X-Goog-Expires", "st"])), (F.col("page_id") % 6 + 1).cast("int"))
    link = F.concat(F.lit("https://example.com/a?limit=5&"), keys, F.lit("=1"))
    return p.select("page_id", text.is_signed(link).alias("signed"))


def f10_extent_overlap(spark, sf_dir):
    """Catalog nodes whose declared extent may meet the area: an unknown one passes."""
    s = view(spark, sf_dir, "scenes")
    known = F.col("ord") % 13 != 0
    return s.filter(~known | geo.intersects(_b(), _area())).groupBy("collection").agg(F.count("*").alias("n"))


def f25_product(spark, sf_dir):
    """Product and side of a geostationary request for each side of a box."""
    p = view(spark, sf_dir, "scenes").select("ord", F.explode(geo.parts(_b())).alias("p")).select("ord", "p.*")
    c = listings.GOES_CONUS
    inside = (F.col("west") >= c.west) & (F.col("east") <= c.east) & (F.col("south") >= c.south) & (F.col("north") <= c.north)
    side = F.when((F.col("west") + F.col("east")) / 2 >= listings.GOES_MERIDIAN, "east").otherwise("west")
    return p.select(F.when(inside, listings.CONUS_PRODUCT).otherwise(listings.DISK_PRODUCT).alias("product"), side.alias("side")).groupBy("product", "side").agg(F.count("*").alias("n"))


def f26_operational_window(spark, sf_dir):
    """Scenes by the satellite that was in service on their day, brought to this century: a table of five rows."""
    rows = [(side, *x) for side, own in listings.GOES_SERVICE.items() for x in own]
    service = spark.createDataFrame(rows, "side string, bucket string, first date, last date")
    day = F.add_months(F.col("ts").cast("date"), 12 * 25)
    # Five literal rows.
    met = view(spark, sf_dir, "scenes").withColumn("day", day).join(F.broadcast(service), F.col("day").between(F.col("first"), F.col("last")))
    return met.groupBy("side", "bucket").agg(F.count("*").alias("n"))


def _r(c, n, digits=6):
    return F.round(c, digits).alias(n)


_STRUCT = ", ".join
_REDACT_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([A-Za-z][A-Za-z0-9+.-]*://[^\s"''<>?#]*)\?[^\s"''<>#]+', '\1?***', 'g'),
  '([A-Za-z][A-Za-z0-9+.-]*://[^\s"''<>#]*)#[^\s"''<>]+', '\1#***', 'g'), '(?i)(^|[^a-z0-9_-])(token|api_key|key)=[^&\s"''<>]+', '\1\2=***', 'g'), '(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+', '\1 ***', 'g')"""

_SPANS = """WITH spans AS (SELECT l_suppkey % 40 AS file, l_orderkey * 9973 % 40000000 AS start, l_orderkey * 9973 % 40000000 + 1000 + l_orderkey * 9973 % 40000000 % 3000 AS stop, count(*) AS n FROM lineitem GROUP BY ALL),
marked AS (SELECT *, CASE WHEN start <= max(stop) OVER w + 8192 THEN 0 ELSE 1 END AS fresh FROM spans WINDOW w AS (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

QUERIES = {
    "g01_lon_span": (_over("scenes", "ord", lambda: geo.lon_span(_b()).alias("span")), oracle("scenes", f"SELECT ord, {SPAN} AS span FROM scenes")),
    "g02_antimeridian_parts": (
        g02_parts,
        oracle("scenes", """SELECT ord, west, south, east, north FROM scenes WHERE west <= east
UNION ALL SELECT ord, west, south, 180, north FROM scenes WHERE west > east AND west < 180
UNION ALL SELECT ord, -180, south, east, north FROM scenes WHERE west > east AND -180 < east"""),
    ),
    "g03_overlap_area": (
        _over("scenes", "ord", lambda: geo.area(_b()).alias("area"), lambda: geo.overlap_area(_b(), _area()).alias("shared")),
        oracle("scenes", f""", lat AS (SELECT *, greatest(0, least(north, 45) - greatest(south, -45)) AS high FROM scenes)
SELECT ord, ({SPAN}) * (north - south) AS area, high * (
  greatest(0, least(CASE WHEN west > east THEN 180 ELSE east END, 180) - greatest(west, 150)) + greatest(0, least(CASE WHEN west > east THEN 180 ELSE east END, -140) - greatest(west, -180))
  + CASE WHEN west > east THEN greatest(0, least(east, 180) - 150) + greatest(0, least(east, -140) + 180) ELSE 0 END) AS shared FROM lat"""),
    ),
    "g04_iou": (
        _over("scenes", "ord", lambda: _r(geo.iou(_b(), geo.Box(_b().west, _b().south + 1, _b().east, _b().north + 1)), "iou")),
        oracle("scenes", """SELECT ord, round(CASE WHEN north - south <= 1 THEN 0 ELSE (north - south - 1) / (north - south + 1) END, 6) AS iou FROM scenes"""),
    ),
    "g05_from_point": (
        _over("detections", "event_id", lambda: geo.from_point(F.col("lon"), F.col("lat"), 0.25).struct().alias("b"), where=None),
        None,
    ),
    "g06_around_point": (
        _over("detections", "event_id", *[(lambda i=i: _r(geo.around(F.col("lon"), F.col("lat"), F.lit(250.0))[i], geo.Box._fields[i])) for i in range(4)]),
        oracle("detections", """, padded AS (SELECT *, 250 / 111.32 AS pad, 250 / 111.32 / cos(radians(lat)) AS wide FROM detections),
told AS (SELECT *, lat - pad <= -90 OR lat + pad >= 90 OR wide >= 180 AS every FROM padded)
SELECT event_id, round(CASE WHEN every THEN -180 WHEN lon - wide < -180 THEN lon - wide + 360 ELSE lon - wide END, 6) AS west, round(greatest(-90, lat - pad), 6) AS south,
  round(CASE WHEN every THEN 180 WHEN lon + wide > 180 THEN lon + wide - 360 ELSE lon + wide END, 6) AS east, round(least(90, lat + pad), 6) AS north FROM told"""),
    ),
    "a21_enclosing_box": (
        a21_enclosing,
        oracle("detections", """, ahead AS (SELECT *, lead(lon) OVER (PARTITION BY user_id, satellite ORDER BY lon) AS next FROM detections),
gaps AS (SELECT user_id, satellite, next - lon AS gap, next AS w, lon AS e FROM ahead WHERE next IS NOT NULL
  UNION ALL SELECT user_id, satellite, 360 - (max(lon) - min(lon)) + 1e-12, min(lon), max(lon) FROM detections GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, satellite ORDER BY gap DESC, w) AS nth FROM gaps)
SELECT user_id, satellite, w AS west, min(lat) AS south, e AS east, max(lat) AS north FROM best JOIN detections USING (user_id, satellite) WHERE nth = 1 GROUP BY ALL"""),
    ),
    "g13_wrap_longitude": (
        _over("detections", "event_id", lambda: _r(geo.wrap_longitude(F.col("lon") * 3), "lon")),
        oracle("detections", """SELECT event_id, round(CASE WHEN lon * 3 < -540 THEN lon * 3 + 720 WHEN lon * 3 < -180 THEN lon * 3 + 360 WHEN lon * 3 >= 540 THEN lon * 3 - 720 WHEN lon * 3 > 180 THEN lon * 3 - 360 ELSE lon * 3 END, 6) AS lon FROM detections"""),
    ),
    "g14_box_centre": (
        _over("scenes", "ord", lambda: geo.centre(_b())[0].alias("lon"), lambda: geo.centre(_b())[1].alias("lat")),
        oracle("scenes", f"SELECT ord, CASE WHEN west + ({SPAN}) / 2 > 180 THEN west + ({SPAN}) / 2 - 360 ELSE west + ({SPAN}) / 2 END AS lon, (south + north) / 2 AS lat FROM scenes"),
    ),
    "g15_disk_segment": (
        _over("detections", "event_id", lambda: geo.segment(F.col("lon"), F.col("lat")).alias("segment")),
        oracle("detections", """, k AS (SELECT 6378.137 AS a, 6356.7523 AS b, 42164.0 AS d), c AS (SELECT event_id, a, b, d, radians(lon - 140.7) AS dl, atan(pow(b / a, 2) * tan(radians(lat))) AS cl FROM detections, k),
v AS (SELECT *, b / sqrt(1 - (1 - pow(b / a, 2)) * pow(cos(cl), 2)) AS rl FROM c),
p AS (SELECT *, d - rl * cos(cl) * cos(dl) AS r1, -rl * cos(cl) * sin(dl) AS r2, rl * sin(cl) AS r3 FROM v),
l AS (SELECT *, 2750.5 + degrees(asin(-r3 / sqrt(r1 * r1 + r2 * r2 + r3 * r3))) / 65536 * 20466275 AS line FROM p)
SELECT event_id, CASE WHEN d * (d - r1) - r2 * r2 - r3 * r3 * pow(a / b, 2) >= 0 AND line >= 1 AND line < 5501 THEN CAST(least(10, floor((line - 1) / 550) + 1) AS INT) END AS segment FROM l"""),
    ),
    "g16_web_mercator": (
        _over("detections", "event_id", lambda: _r(geo.mercator(F.col("lon"), F.col("lat"))[0], "x", 3), lambda: _r(geo.mercator(F.col("lon"), F.col("lat"))[1], "y", 3)),
        oracle("detections", """SELECT event_id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(pi() / 4 + radians(least(greatest(lat, -85.05112878), 85.05112878)) / 2)) * 6378137, 3) AS y FROM detections"""),
    ),
    "g17_utm": (
        _over(
            "detections",
            "event_id",
            *[(lambda i=i, n=n: _r(geo.utm(F.col("lon"), F.col("lat"), F.floor((F.col("lon") + 180) / 6) + 1, F.col("lat") >= 0)[i], n, 3)) for i, n in ((0, "easting"), (1, "northing"))],
            where="abs(lat) < 84",
        ),
        oracle("detections", """, k AS (SELECT 6378137.0 AS a, 1 / 298.257223563 AS f), e AS (SELECT a, f * (2 - f) AS e2, f * (2 - f) / (1 - f * (2 - f)) AS ep FROM k),
q AS (SELECT event_id, lat >= 0 AS up, radians(lat) AS p, radians(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS dl, e.* FROM detections, e WHERE abs(lat) < 84),
w AS (SELECT *, a / sqrt(1 - e2 * pow(sin(p), 2)) AS n, pow(tan(p), 2) AS t, ep * pow(cos(p), 2) AS c, cos(p) * dl AS d,
  a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p)
     + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - 35 * pow(e2, 3) / 3072 * sin(6 * p)) AS m FROM q)
SELECT event_id, round(500000 + 0.9996 * n * (d + (1 - t + c) * pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(d, 5) / 120), 3) AS easting,
  round(0.9996 * (m + n * tan(p) * (pow(d, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(d, 6) / 720))
    + CASE WHEN up THEN 0 ELSE 10000000 END, 3) AS northing FROM w"""),
    ),
    "g18_slippy_tile": (
        _over("detections", "event_id", lambda: geo.tile(F.col("lon"), F.col("lat"), 9)[0].alias("x"), lambda: geo.tile(F.col("lon"), F.col("lat"), 9)[1].alias("y"), lambda: _r(geo.pixel(F.col("lon"), F.col("lat"), 9)[0], "px", 3), where="abs(lat) < 85"),
        oracle("detections", """SELECT event_id, CAST(trunc((lon + 180) / 360 * 512) AS INT) AS x, CAST(trunc((1 - asinh(tan(radians(lat))) / pi()) / 2 * 512) AS INT) AS y,
  round((lon + 180) / 360 * 256 * 512, 3) AS px FROM detections WHERE abs(lat) < 85"""),
    ),
    "g19_model_bounds": (
        g19_model_bounds,
        oracle("scenes", """SELECT ord, round(radians(west) * 6378137, 3) AS min_x, round(radians(east) * 6378137, 3) AS max_x,
  round(ln(tan(pi() / 4 + radians(greatest(south, -85.05112878)) / 2)) * 6378137, 3) AS min_y, round(ln(tan(pi() / 4 + radians(least(north, 85.05112878)) / 2)) * 6378137, 3) AS max_y
FROM scenes WHERE west <= east"""),
    ),
    "g20_pixel_window": (
        lambda spark, sf_dir: view(spark, sf_dir, "scenes").filter("west <= east").select(
            "ord", geo.pixel_window(_b(), F.lit(-100.0), F.lit(60.0), F.lit(0.3), F.lit(0.3), F.lit(600), F.lit(400)).alias("w")
        ).filter("w IS NOT NULL").select("ord", "w.*"),
        oracle("scenes", """, raw AS (SELECT ord, (west + 100) / 0.3 AS a, (60 - north) / 0.3 AS b, (east + 100) / 0.3 AS c, (60 - south) / 0.3 AS d FROM scenes WHERE west <= east),
snap AS (SELECT ord, CASE WHEN abs(a - round_even(a, 0)) <= 1e-8 THEN round_even(a, 0) ELSE floor(a) END AS a, CASE WHEN abs(b - round_even(b, 0)) <= 1e-8 THEN round_even(b, 0) ELSE floor(b) END AS b,
  CASE WHEN abs(c - round_even(c, 0)) <= 1e-8 THEN round_even(c, 0) ELSE ceil(c) END AS c, CASE WHEN abs(d - round_even(d, 0)) <= 1e-8 THEN round_even(d, 0) ELSE ceil(d) END AS d FROM raw)
SELECT ord, CAST(greatest(0, a) AS INT) AS col0, CAST(greatest(0, b) AS INT) AS row0, CAST(least(600, c) AS INT) AS col1, CAST(least(400, d) AS INT) AS row1 FROM snap
WHERE least(600, c) > greatest(0, a) AND least(400, d) > greatest(0, b)"""),
    ),
    "g21_coalesced_ranges": (
        g21_coalesced_ranges,
        _SPANS + """,
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT file, min(start) AS start, max(stop) AS stop, CAST(sum(n) AS BIGINT) AS n FROM runs GROUP BY file, run""",
    ),
    "g21_capped_reads": (
        g21_capped_reads,
        """WITH RECURSIVE spans AS (SELECT l_suppkey % 40 AS file, l_orderkey * 9973 % 40000000 AS start, l_orderkey * 9973 % 40000000 + 1000 + l_orderkey * 9973 % 40000000 % 3000 AS stop, count(*) AS n FROM lineitem GROUP BY ALL),
nth AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY start, stop) AS i FROM spans),
walk(file, i, a, b, n, read) AS (SELECT file, i, start, stop, n, 1 FROM nth WHERE i = 1
  UNION ALL SELECT t.file, t.i, CASE WHEN j THEN a ELSE t.start END, CASE WHEN j THEN greatest(b, t.stop) ELSE t.stop END, t.n, CASE WHEN j THEN read ELSE read + 1 END
  FROM (SELECT n.*, w.a, w.b, w.read, n.start <= w.b + 65536 AND greatest(w.b, n.stop) - w.a <= 8388608 AS j FROM walk w JOIN nth n ON n.file = w.file AND n.i = w.i + 1) t)
SELECT file, min(a) AS start, max(b) AS stop, CAST(sum(n) AS BIGINT) AS n FROM walk GROUP BY file, read""",
    ),
    "g21_tile_range": (
        g21_tile_range,
        oracle("detections", """, w AS (SELECT event_id, greatest(0, event_id * 37 % 12000 - 1000) AS a, least(10000, event_id * 37 % 12000 - 1000 + event_id % 700) AS b FROM detections)
SELECT event_id, CAST(a // 256 AS INT) AS first, CAST((b - 1) // 256 AS INT) AS last FROM w WHERE a < b"""),
    ),
    "g23_smaller_overlap": (
        _over("scenes", "ord", lambda: _r(geo.overlap_of_smaller(_b(), geo.Box(_b().west, _b().south + 1, _b().east, _b().north + 3)), "share")),
        oracle("scenes", "SELECT ord, round(greatest(0, north - south - 1) / (north - south), 6) AS share FROM scenes"),
    ),
    "d02_written_utc": (
        _over("detections", "event_id", lambda: times.written(F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 2).cast("decimal(18,6)") / 4)).alias("said")),
        oracle("detections", """SELECT event_id, strftime(ts + CASE WHEN event_id % 2 = 1 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN (epoch_us(ts) + event_id % 2 * 250000) % 1000000 <> 0 THEN '.' || lpad(CAST((epoch_us(ts) + event_id % 2 * 250000) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS said FROM detections"""),
    ),
    "d03_day_list": (
        d03_day_list,
        oracle("scenes", """SELECT ord, CAST(day AS DATE) AS day, CAST(dayofyear(day) AS INT) AS doy FROM (
  SELECT ord, unnest(generate_series(CAST(ts AS DATE), CAST(ts AS DATE) + CAST(ord % 7 AS INT), INTERVAL 1 DAY)) AS day FROM scenes)"""),
    ),
    "d05_backward_chunks": (
        d05_backward_chunks,
        oracle("scenes", """, span AS (SELECT ord, CAST(ts AS DATE) AS start, CAST(ts AS DATE) + CAST(ord % 37 AS INT) AS stop FROM scenes),
steps AS (SELECT *, unnest(range(4)) AS k FROM span)
SELECT ord, greatest(start, stop - CAST(k * 10 + 9 AS INT)) AS first, stop - CAST(k * 10 AS INT) AS last FROM steps WHERE stop - CAST(k * 10 AS INT) >= start"""),
    ),
    "d06_interval_overlap": (
        d06_interval_overlap,
        oracle("scenes", """SELECT ord FROM scenes WHERE (ord % 4 = 0 OR CAST(ts AS DATE) <= DATE '1995-03-31') AND (ord % 3 = 0 OR CAST(ts AS DATE) + 40 >= DATE '1995-03-01')"""),
    ),
    "f10_extent_overlap": (
        f10_extent_overlap,
        oracle("scenes", """SELECT collection, count(*) AS n FROM scenes WHERE ord % 13 = 0 OR (north >= -45 AND 45 >= south AND (west > east OR east >= 150 OR west <= -140)) GROUP BY collection"""),
    ),
    "f11_finished_hours": (
        f11_finished_hours,
        oracle("detections", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM detections WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00' GROUP BY 1"),
    ),
    "f12_settled": (
        f12_settled,
        oracle("detections", "SELECT satellite, count(*) AS n, max(ts) AS newest FROM detections WHERE ts <= TIMESTAMP '2024-01-20 09:30:00' GROUP BY satellite"),
    ),
    "f21_time_tolerance": (
        lambda spark, sf_dir: view(spark, sf_dir, "detections").filter(times.within_seconds(F.col("ts"), F.date_trunc("hour", "ts"), 60)).select("event_id"),
        oracle("detections", "SELECT event_id FROM detections WHERE epoch_us(ts) - epoch_us(date_trunc('hour', ts)) <= 60000000"),
    ),
    "f24_signed_links": (
        f24_signed_links,
        "SELECT page_id, page_id % 6 IN (1, 2, 4, 5) AS signed FROM pages",
    ),
    "f25_goes_product": (
        f25_product,
        oracle("scenes", """, part AS (SELECT west, south, east, north FROM scenes WHERE west <= east UNION ALL SELECT west, south, 180, north FROM scenes WHERE west > east AND west < 180
UNION ALL SELECT -180, south, east, north FROM scenes WHERE west > east AND -180 < east)
SELECT CASE WHEN west >= -125 AND east <= -66 AND south >= 24 AND north <= 50 THEN 'ABI-L2-MCMIPC' ELSE 'ABI-L2-MCMIPF' END AS product,
  CASE WHEN (west + east) / 2 >= -105 THEN 'east' ELSE 'west' END AS side, count(*) AS n FROM part GROUP BY ALL"""),
    ),
    "f26_operational_window": (
        f26_operational_window,
        oracle("scenes", """, service(side, bucket, first, last) AS (VALUES ('east', 'noaa-goes16', DATE '2017-12-18', DATE '2025-04-06'), ('east', 'noaa-goes19', DATE '2025-04-07', DATE '9999-12-31'),
  ('west', 'noaa-goes15', DATE '2012-01-01', DATE '2019-02-11'), ('west', 'noaa-goes17', DATE '2019-02-12', DATE '2023-01-03'), ('west', 'noaa-goes18', DATE '2023-01-04', DATE '9999-12-31'))
SELECT side, bucket, count(*) AS n FROM scenes JOIN service ON CAST(ts + INTERVAL 25 YEAR AS DATE) BETWEEN first AND last GROUP BY ALL"""),
    ),
    "s01_redacted": (
        s01_redacted,
        "SELECT page_id, " + _REDACT_SQL.format(x="'GET ' || url || '?token=abc' || page_id || '#frag failed; api_key=K' || page_id || ' Bearer zz' || page_id || ' end'") + " AS said FROM pages",
    ),
    "s02_scrubbed_key": (s02_scrubbed_key, "SELECT page_id, 'https://firms.example/api/area/csv/***/VIIRS_SNPP_NRT/1,2,3,4/1' AS said FROM pages"),
    "s03_index_id": (
        _over("scenes", "ord", lambda: text.index_id(F.col("source"), F.col("collection"), F.col("id")).alias("index_id")),
        oracle("scenes", "SELECT ord, 'sc_' || substr(sha256(source || chr(31) || collection || chr(31) || id), 1, 20) AS index_id FROM scenes"),
    ),
    "s05_scene_filename": (
        _over("assets", "ord", lambda: text.scene_filename(F.concat(F.lit("scene ("), F.col("ord").cast("string"), F.lit(").tif")), F.col("key"), F.lit("tif")).alias("name")),
        None,
    ),
    "s07_token": (
        _over("sources", "source", lambda: text.token(F.concat(F.lit("  "), F.upper("source"), F.lit("-2_A "))).alias("token")),
        oracle("sources", "SELECT source, replace(source, '_', '') || '2a' AS token FROM sources"),
    ),
    "s09_bytes_label": (
        _over("assets", "ord", lambda: text.bytes_label(F.col("size_bytes") * F.col("ord") + F.col("ord")).alias("said"), where="size_bytes IS NOT NULL"),
        oracle("assets", """, n AS (SELECT ord, size_bytes * ord + ord AS n FROM assets WHERE size_bytes IS NOT NULL),
u AS (SELECT *, CASE WHEN n >= pow(1024, 4) THEN 4 WHEN n >= pow(1024, 3) THEN 3 WHEN n >= pow(1024, 2) THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM n)
SELECT ord, CASE WHEN n / pow(1024, k) = floor(n / pow(1024, k)) THEN CAST(CAST(n / pow(1024, k) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', n / pow(1024, k)) END
  || ' ' || ['bytes', 'KB', 'MB', 'GB', 'TB'][k + 1] AS said FROM u"""),
    ),
    "s10_tokens_label": (
        _over("usage", "conv_id", "turn", lambda: text.tokens_label(F.col("tokens") * F.pow(F.lit(7), F.col("turn") % 9).cast("bigint")).alias("said")),
        oracle("usage", """, v AS (SELECT conv_id, turn, tokens * CAST(pow(7, turn % 9) AS BIGINT) AS n FROM usage),
d AS (SELECT *, CAST(pow(10, greatest(0, length(CAST(n AS VARCHAR)) - 3)) AS BIGINT) AS f FROM v),
r AS (SELECT *, CASE WHEN n < 1000 THEN n ELSE (2 * n + f) // (2 * f) * f END AS x FROM d),
u AS (SELECT *, CASE WHEN x >= 1000000000 THEN 1000000000 WHEN x >= 1000000 THEN 1000000 WHEN x >= 1000 THEN 1000 ELSE 1 END AS unit FROM r)
SELECT conv_id, turn, CASE WHEN n <= 0 THEN '0' WHEN unit = 1 THEN CAST(x AS VARCHAR) ELSE
  CASE WHEN x // unit >= 100 THEN CAST(x // unit AS VARCHAR) WHEN x // unit >= 10 THEN (x // unit) || '.' || (x % unit // (unit // 10)) ELSE (x // unit) || '.' || lpad(CAST(x % unit // (unit // 100) AS VARCHAR), 2, '0') END
  || CASE unit WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END END AS said FROM u"""),
    ),
    "s06_asset_suffix": (
        s06_asset_suffix,
        oracle("assets", """, m AS (SELECT ord, CASE ord % 3 WHEN 0 THEN media_type WHEN 1 THEN 'application/octet-stream' END AS media FROM assets)
SELECT ord, CASE WHEN contains(media, 'tiff') THEN '.tif' WHEN contains(media, 'hdf') THEN '.hdf' WHEN contains(media, 'png') THEN '.png' WHEN contains(media, 'jpeg') THEN '.jpg'
  ELSE ['.tif', '.jpg', '.dat.bz2', '.zip', '.bin', '.nc', '.bin', '.bin'][ord % 8 + 1] END AS suffix FROM m"""),
    ),
    "s11_error_text": (
        s11_error_text,
        "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND url IS NOT NULL THEN 'ReadTimeout: failed at ' || trim(regexp_replace(" + _REDACT_SQL.format(x="url || '?key=v'") + ", '\\s+', ' ', 'g')) ELSE 'ReadTimeout' END AS said FROM pages",
    ),
    "s12_without_controls": (s12_without_controls, "SELECT conv_id, turn, md5(text) AS digest FROM conversations"),
    "s13_compacted": (
        s13_compacted,
        """WITH t AS (SELECT doc_id, CASE WHEN length(text) > 500 AND NOT regexp_matches(text, '\\n\\.\\.\\.\\[\\d+ characters compacted\\]\\.\\.\\.\\n')
  THEN substr(text, 1, 250) || chr(10) || '...[' || (length(text) - 500) || ' characters compacted]...' || chr(10) || substr(text, length(text) - 249) ELSE text END AS x FROM documents)
SELECT doc_id, md5(x) AS digest, length(x) AS n FROM t""",
    ),
    "s14_truncated": (
        s14_truncated,
        """WITH t AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...[truncated ' || (length(text) - 1000) || ' characters]' ELSE text END AS x FROM documents)
SELECT doc_id, length(x) AS n, md5(x) AS digest FROM t""",
    ),
}
QUERIES["g05_from_point"] = (
    lambda spark, sf_dir: view(spark, sf_dir, "detections").select("event_id", geo.from_point(F.col("lon"), F.col("lat"), 0.25).struct().alias("b")).select("event_id", "b.*"),
    oracle("detections", "SELECT event_id, greatest(-180, lon - 0.25) AS west, greatest(-90, lat - 0.25) AS south, least(180, lon + 0.25) AS east, least(90, lat + 0.25) AS north FROM detections"),
)
QUERIES["s05_scene_filename"] = (
    QUERIES["s05_scene_filename"][0],
    oracle("assets", "SELECT ord, 'scene_' || ord || '__' || key || '.tif' AS name FROM assets"),
)
