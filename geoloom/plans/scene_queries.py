"""Queries over scenes: filters, order, limits, coverage, consolidation; each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geo, rings, times
from geoloom.operators import scenes as S
from geoloom.plans.ring_sql import EDGES, HITS
from geoloom.plans.views import oracle, view
from geoloom.request import BBox, Polygon, PullRequest

#: Areas that the queries ask for: one across 180 degrees, one not.
DATELINE, PLAIN = BBox(150.0, -45.0, -140.0, 45.0), BBox(-60.0, -20.0, 60.0, 20.0)
RING = Polygon(((10.0, -30.0), (60.0, -40.0), (90.0, 5.0), (40.0, 10.0), (55.0, 45.0), (5.0, 30.0), (10.0, -30.0)))
START, END = dt.date(1995, 1, 1), dt.date(1997, 6, 30)


def _request(**more) -> PullRequest:
    return PullRequest(START, END, DATELINE, **more)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of the request's days and area."""
    s = view(spark, sf_dir, "scenes")
    return s.filter(times.within_days(F.col("ts"), str(START), str(END)) & rings.overlaps_area(DATELINE, geo.Box.col()))


#: The same clip in SQL: an area across 180 degrees against boxes that may cross it too.
_MEETS = """(north >= {s} AND {n} >= south AND (
  ((west <= east OR west > east) AND west <= {w2} AND {w1} <= CASE WHEN west > east THEN 180 ELSE east END)
  OR (west <= {e2} AND {e1} <= CASE WHEN west > east THEN 180 ELSE east END)
  OR (west > east AND {w1} <= east AND -180 <= {w2}) OR (west > east AND {e1} <= east AND -180 <= {e2})))"""
MEETS_DATELINE = _MEETS.format(s=-45, n=45, w1=150, w2=180, e1=-180, e2=-140)
IN_DAYS = "ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-07-01'"
WANTED = f", wanted AS (SELECT * FROM scenes WHERE {IN_DAYS} AND {MEETS_DATELINE})"
CLOUD_OK = "(kind NOT IN ('optical', 'browse') OR cloud IS NULL OR cloud {})"
COUNTED = "geometry_kind <> 'point' AND NOT footprint_is_request AND kind NOT IN ('browse', 'lidar', 'altimetry')"
LATTICE = """, axis AS (SELECT unnest(range(16)) AS i), lattice AS (
  SELECT CASE WHEN 150 + 70 * (a.i + 0.5) / 16 > 180 THEN 150 + 70 * (a.i + 0.5) / 16 - 360 ELSE 150 + 70 * (a.i + 0.5) / 16 END AS plon,
         -45 + 90 * (b.i + 0.5) / 16 AS plat FROM axis a, axis b)"""
HOLDS = "plat >= south AND plat <= north AND CASE WHEN west > east THEN plon >= west OR plon <= east ELSE plon >= west AND plon <= east END"
DEDUPED = ", chosen AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY ord) AS nth FROM kept) WHERE nth = 1)"
CLEAREST = "CASE WHEN kind IN ('optical', 'browse') AND cloud IS NOT NULL THEN cloud ELSE -1 END, ts DESC, ord"


def f01_cloud_range(spark, sf_dir):
    return view(spark, sf_dir, "scenes").filter(S.cloud_within(10, 60)).select("ord", "id", "kind", "cloud")


def f03_contains_point(spark, sf_dir):
    hit = geo.contains(geo.Box.col(), F.lit(179.5), F.lit(-10.0)) | geo.contains(geo.Box.col(), F.lit(-180.0), F.lit(20.0))
    return view(spark, sf_dir, "scenes").filter(hit).select("ord", "west", "south", "east", "north")


def f04_intersects_box(spark, sf_dir):
    return view(spark, sf_dir, "scenes").filter(geo.intersects(geo.Box.col(), geo.Box.of(*DATELINE.edges))).select("ord", "id", "west", "east")


def f05_ring_contains(spark, sf_dir):
    hit = geo.contains(rings.box_of(RING), F.col("lon"), F.col("lat")) & rings.ring_contains(RING, F.col("lon"), F.col("lat"))
    return view(spark, sf_dir, "detections").filter(hit).select("event_id", "lon", "lat")


_EDGES = "edges(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING.plane, RING.plane[1:], strict=False)) + ")"
_CROSSES = "(y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1"


def f06_ring_meets_box(spark, sf_dir):
    return view(spark, sf_dir, "scenes").filter(rings.overlaps_area(RING, geo.Box.col())).select("ord", "west", "south", "east", "north")


_RING = ", areas AS (SELECT 0 AS area_id, [" + ", ".join(f"[{x}, {y}]" for x, y in RING.ring) + "] AS ring)" + EDGES


def f07_overlaps_ring(spark, sf_dir):
    hit = rings.overlaps_area(RING, geo.Box.col(), F.col("geometry_kind"), F.col("lon"), F.col("lat"))
    return view(spark, sf_dir, "scenes").filter(hit).select("ord", "geometry_kind")


def f08_area_clip(spark, sf_dir):
    return _wanted(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def f09_date_window(spark, sf_dir):
    return view(spark, sf_dir, "scenes").filter(times.within_days(F.col("ts"), str(START), str(END))).groupBy("kind").agg(F.count("*").alias("n"))


def f13_counts_for_coverage(spark, sf_dir):
    return view(spark, sf_dir, "scenes").filter(S.counts_for_coverage()).groupBy("source", "kind").agg(F.count("*").alias("n"))


def f14_ok_sources(spark, sf_dir):
    """Sources that answered with scenes, of all that were asked."""
    asked = spark.range(9).select(F.concat(F.lit("src"), "id").alias("source"), F.when(F.col("id") == 3, F.lit("HTTP 503")).alias("error"))
    n = view(spark, sf_dir, "scenes").groupBy("source").agg(F.count("*").alias("n_scenes"))
    return asked.filter(F.col("error").isNull()).join(n, "source").select("source", "n_scenes")


def w01_first_of_each_id(spark, sf_dir):
    return S.first_of_each(view(spark, sf_dir, "scenes"), ["source", "id"]).select("source", "id", "ord", "cloud")


def _limited(mode: str):
    def query(spark, sf_dir):
        return S.picked(view(spark, sf_dir, "scenes"), 25, mode).select("source", "ord", "id")

    return query


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, ord) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM scenes)"
_MODES = {"first": "place < 25", "last": "place >= n - 25", "even": "place IN (SELECT round_even(i * (n - 1) / 24.0, 0) FROM (SELECT unnest(range(25)) AS i))"}


def o01_clearest_first(spark, sf_dir):
    return S.ranked(view(spark, sf_dir, "scenes")).select("source", "ord", F.col("rank").cast("bigint").alias("rank"))


def o02_select(spark, sf_dir):
    return S.select(_wanted(spark, sf_dir), _request(max_cloud=70, limit=12, limit_mode="even")).select("source", "id", "ord", "cloud")


def o03_mosaic_sample(spark, sf_dir):
    return S.mosaic_sample(view(spark, sf_dir, "scenes"))


def o04_newest(spark, sf_dir):
    return S.newest(view(spark, sf_dir, "scenes"), 40).select("ord", "id")


def o05_early_stop(spark, sf_dir):
    """Of lists in order (source, then time) as many scenes as a limit over all of them leaves."""
    return view(spark, sf_dir, "scenes").orderBy("source", F.col("ts").desc(), "ord").limit(500).select("source", "ord")


def a01_coverage(spark, sf_dir):
    return S.coverage(_wanted(spark, sf_dir), DATELINE)


def a01_coverage_all(spark, sf_dir):
    return S.coverage(view(spark, sf_dir, "scenes"), DATELINE, keys=())


def a02_representative_cloud(spark, sf_dir):
    return S.representative_cloud(view(spark, sf_dir, "scenes"))


def a03_consolidate(spark, sf_dir):
    """The flagship: what a request leaves of each source."""
    return S.consolidated_scenes(_wanted(spark, sf_dir), _request(max_cloud=40))


def a04_analysis_input(spark, sf_dir):
    """Few scenes, so that too little is clear."""
    return S.analysis_input(_wanted(spark, sf_dir), _request())


def a05_totals(spark, sf_dir):
    return view(spark, sf_dir, "scenes").agg(F.count("*").alias("total"), F.countDistinct("id").alias("ids"), F.countDistinct("source").alias("sources"))


def u01_union_of_sources(spark, sf_dir):
    """Lists of two families, one of them failed, as one table with a status row a source."""
    s = view(spark, sf_dir, "scenes").select("source", "id", "ord")
    d = view(spark, sf_dir, "detections").select(F.concat(F.lit("firms_"), "satellite").alias("source"), F.concat(F.lit("D"), "event_id").alias("id"), "ord")
    found = s.unionByName(d).groupBy("source").agg(F.count("*").alias("n_scenes"))
    status = found.select("source", F.lit(None).cast("string").alias("error"), "n_scenes")
    return status.unionByName(spark.range(1).select(F.lit("broken").alias("source"), F.lit("HTTP 500").alias("error"), F.lit(0).cast("bigint").alias("n_scenes")))


def u02_append_radar(spark, sf_dir):
    """Radar scenes put behind the lists that have none."""
    s = view(spark, sf_dir, "scenes")
    radar = s.filter("kind = 'sar'").select(F.lit("sentinel1").alias("source"), "id", "ord")
    return s.filter("kind <> 'sar'").select("source", "id", "ord").unionByName(radar).groupBy("source").agg(F.count("*").alias("n"), F.max("ord").alias("last_ord"))


def u07_difference(spark, sf_dir):
    """Ids of one list that the other lacks."""
    s = view(spark, sf_dir, "scenes")
    return s.filter("source = 'src1'").select("id").subtract(s.filter("source = 'src2'").select("id"))


def u08_part_merge(spark, sf_dir):
    """Scenes found on either side of 180 degrees, each id once: that of the western part first."""
    s = view(spark, sf_dir, "scenes")
    b = geo.Box.col()
    found = [s.filter(geo.intersects(b, geo.Box.of(*p.edges))).withColumn("part", F.lit(i)) for i, p in enumerate(DATELINE.parts)]
    both = found[0].unionByName(found[1]).withColumn("ord", F.col("part") * (1 << 40) + F.col("ord"))
    return S.first_of_each(both, ["id"]).select("id", "part", (F.col("ord") % (1 << 40)).alias("ord"))


_part = lambda w, e: _MEETS.format(s=-45, n=45, w1=w, w2=e, e1=w, e2=e)

QUERIES = {
    "f01_cloud_range": (f01_cloud_range, oracle("scenes", f"SELECT ord, id, kind, cloud FROM scenes WHERE {CLOUD_OK.format('BETWEEN 10 AND 60')}")),
    "f03_contains_point": (
        f03_contains_point,
        oracle("scenes", """, points(plon, plat) AS (VALUES (179.5, -10.0), (-180.0, 20.0))
SELECT ord, west, south, east, north FROM scenes WHERE EXISTS (SELECT 1 FROM points WHERE """ + HOLDS + ")"),
    ),
    "f04_intersects_box": (f04_intersects_box, oracle("scenes", f"SELECT ord, id, west, east FROM scenes WHERE {MEETS_DATELINE}")),
    "f05_ring_contains": (
        f05_ring_contains,
        oracle("detections", f""", {_EDGES}
SELECT event_id, lon, lat FROM detections WHERE (SELECT count(*) FROM edges WHERE {_CROSSES.format(x='lon', y='lat')}) % 2 = 1
  OR EXISTS (SELECT 1 FROM edges WHERE abs((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) <= 1e-9
             AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2))"""),
    ),
    "f06_ring_meets_box": (
        f06_ring_meets_box,
        oracle("scenes", _RING + HITS.replace(" WHERE geometry_kind <> 'point'", "") + " SELECT ord, west, south, east, north FROM scenes WHERE ord IN (SELECT ord FROM boxed)"),
    ),
    "f07_overlaps_ring": (
        f07_overlaps_ring,
        oracle("scenes", _RING + HITS + " SELECT ord, geometry_kind FROM scenes WHERE ord IN (SELECT ord FROM hits)"),
    ),
    "f08_area_clip": (f08_area_clip, oracle("scenes", WANTED + "SELECT source, count(*) AS n, min(ord) AS first_ord FROM wanted GROUP BY source")),
    "f09_date_window": (f09_date_window, oracle("scenes", f"SELECT kind, count(*) AS n FROM scenes WHERE {IN_DAYS} GROUP BY kind")),
    "f13_counts_for_coverage": (f13_counts_for_coverage, oracle("scenes", f"SELECT source, kind, count(*) AS n FROM scenes WHERE {COUNTED} GROUP BY ALL")),
    "f14_ok_sources": (f14_ok_sources, oracle("scenes", "SELECT source, count(*) AS n_scenes FROM scenes WHERE source <> 'src3' GROUP BY source")),
    "w01_first_of_each_id": (
        w01_first_of_each_id,
        oracle("scenes", ", kept AS (SELECT * FROM scenes)" + DEDUPED + "SELECT source, id, ord, cloud FROM chosen"),
    ),
    **{f"w02_limit_{m}": (_limited(m), oracle("scenes", f", {_RANKED} SELECT source, ord, id FROM ranked WHERE {w}")) for m, w in _MODES.items()},
    "o01_clearest_first": (
        o01_clearest_first,
        oracle("scenes", f"SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY {CLEAREST}) AS rank FROM scenes"),
    ),
    "o02_select": (
        o02_select,
        oracle("scenes", WANTED + f", kept AS (SELECT * FROM wanted WHERE {CLOUD_OK.format('<= 70')})" + DEDUPED + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, ord) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM chosen)
SELECT source, id, ord, cloud FROM ranked WHERE n <= 12 OR place IN (SELECT round_even(i * (n - 1) / 11.0, 0) FROM (SELECT unnest(range(12)) AS i))"""),
    ),
    "o03_mosaic_sample": (
        o03_mosaic_sample,
        oracle("scenes", "SELECT source, id, cloud FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cloud NULLS LAST, ord) AS nth FROM scenes) WHERE nth = 1"),
    ),
    "o04_newest": (o04_newest, oracle("scenes", "SELECT ord, id FROM scenes ORDER BY ts DESC, ord LIMIT 40")),
    "o05_early_stop": (o05_early_stop, oracle("scenes", "SELECT source, ord FROM scenes ORDER BY source, ts DESC, ord LIMIT 500")),
    "a01_coverage": (
        a01_coverage,
        oracle("scenes", WANTED + LATTICE + f""", names AS (SELECT DISTINCT source FROM wanted), boxes AS (SELECT * FROM wanted WHERE {COUNTED})
SELECT n.source, coalesce(c.hits, 0) / 256 AS coverage FROM names n LEFT JOIN (
  SELECT source, count(DISTINCT (plon, plat)) AS hits FROM boxes, lattice WHERE {HOLDS} GROUP BY source) c USING (source)"""),
    ),
    "a01_coverage_all": (
        a01_coverage_all,
        oracle("scenes", LATTICE + f"SELECT count(DISTINCT (plon, plat)) / 256 AS coverage FROM scenes, lattice WHERE {COUNTED} AND {HOLDS}"),
    ),
    "a02_representative_cloud": (
        a02_representative_cloud,
        oracle("scenes", "SELECT source, collection, min(CASE WHEN kind IN ('optical', 'browse') THEN cloud END) AS cloud FROM scenes GROUP BY ALL"),
    ),
    "a03_consolidate": (
        a03_consolidate,
        oracle("scenes", WANTED + f", kept AS (SELECT * FROM wanted WHERE {CLOUD_OK.format('<= 40')})" + DEDUPED + LATTICE + f""",
covered AS (SELECT source, count(DISTINCT (plon, plat)) / 256 AS coverage FROM chosen, lattice WHERE {COUNTED} AND {HOLDS} GROUP BY source)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY {CLEAREST}) AS INT) AS rank, id, count(*) OVER (PARTITION BY source) AS n_scenes,
  min(CASE WHEN kind IN ('optical', 'browse') THEN cloud END) OVER (PARTITION BY source) AS cloud, coalesce(coverage, 0) AS coverage
FROM chosen LEFT JOIN covered USING (source)"""),
    ),
    "a04_analysis_input": (
        a04_analysis_input,
        oracle("scenes", WANTED + LATTICE + f""", few AS (SELECT * FROM wanted),
clear AS (SELECT count(DISTINCT (plon, plat)) / 256 AS clear FROM few, lattice WHERE kind = 'optical' AND (cloud IS NULL OR cloud <= 20) AND {COUNTED} AND {HOLDS}),
counts AS (SELECT count(*) FILTER (kind = 'optical') AS n_optical, count(*) FILTER (kind = 'sar') AS n_sar,
  string_agg(DISTINCT CASE WHEN kind = 'sar' THEN source END, ', ' ORDER BY CASE WHEN kind = 'sar' THEN source END) AS names FROM few)
SELECT n_optical, n_sar, clear, CASE WHEN clear < 0.5 AND n_sar > 0 THEN 'sar' WHEN n_optical > 0 THEN 'optical' END AS analysis_input,
  CASE WHEN clear < 0.5 AND n_sar > 0 AND n_optical > 0 THEN 'optical skipped for cloud: ' || CAST(round_even(clear * 100, 0) AS INT) || '% of the AOI has optical at or under 20% cloud, below the 50% threshold; using SAR from ' || names
       WHEN clear < 0.5 AND n_sar > 0 THEN 'optical unavailable: no optical scenes returned (0% clear coverage); using SAR from ' || names END AS note
FROM counts, clear"""),
    ),
    "a05_totals": (a05_totals, oracle("scenes", "SELECT count(*) AS total, count(DISTINCT id) AS ids, count(DISTINCT source) AS sources FROM scenes")),
    "u01_union_of_sources": (
        u01_union_of_sources,
        oracle("scenes detections", """SELECT source, CAST(NULL AS VARCHAR) AS error, count(*) AS n_scenes FROM scenes GROUP BY source
UNION ALL SELECT 'firms_' || satellite, NULL, count(*) FROM detections GROUP BY satellite UNION ALL SELECT 'broken', 'HTTP 500', 0"""),
    ),
    "u02_append_radar": (
        u02_append_radar,
        oracle("scenes", "SELECT CASE WHEN kind = 'sar' THEN 'sentinel1' ELSE source END AS source, count(*) AS n, max(ord) AS last_ord FROM scenes GROUP BY 1"),
    ),
    "u07_difference": (u07_difference, oracle("scenes", "SELECT id FROM scenes WHERE source = 'src1' EXCEPT SELECT id FROM scenes WHERE source = 'src2'")),
    "u08_part_merge": (
        u08_part_merge,
        oracle("scenes", f""", both_parts AS (SELECT *, 0 AS part FROM scenes WHERE {_part(150, 180)} UNION ALL SELECT *, 1 FROM scenes WHERE {_part(-180, -140)})
SELECT id, part, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, ord) AS nth FROM both_parts) WHERE nth = 1"""),
    ),
}
