"""The test tables seen as scenes, detections, pixels, assets, usage: one text each, which Spark and DuckDB both read.

Keys and places come from whole-number arithmetic, so that both engines have the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.tables import read


def _choice(number: str, values: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_KINDS = "optical optical optical optical browse sar sar thermal lidar dem atmosphere detection altimetry precipitation landcover landsurface".split()

_CORNERS = ((0, 0), (15, -8), (23, 8), (12, 6), (10, 17), (-4, 11), (0, 0))
_LON, _LAT, _SIZE = "((n_nationkey * 47) % 360 - 178)", "((n_nationkey * 23) % 101 - 55)", "(1 + n_nationkey % 3) / 2.0"
_RING = "array(" + ", ".join(
    f"array(CAST(CASE WHEN {_LON} + {x} * {_SIZE} > 180 THEN {_LON} + {x} * {_SIZE} - 360 WHEN {_LON} + {x} * {_SIZE} < -180 THEN {_LON} + {x} * {_SIZE} + 360 ELSE {_LON} + {x} * {_SIZE} END AS DOUBLE), CAST({_LAT} + {y} * {_SIZE} AS DOUBLE))"
    for x, y in _CORNERS
) + ")"

#: name: (tables, SQL with their names in braces).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "scenes": (
        ("orders",),
        f"""SELECT o_orderkey AS ord, concat('S', CAST(o_orderkey % 997 AS STRING)) AS id,
  concat('src', CAST(o_custkey % 7 AS STRING)) AS source, concat('c', CAST(o_custkey % 3 AS STRING)) AS collection,
  {_choice("o_orderkey % 16", _KINDS)} AS kind, o_orderdate AS ts,
  CAST((o_custkey * 37) % 360 - 180 AS DOUBLE) AS west, CAST((o_orderkey * 17) % 160 - 80 AS DOUBLE) AS south,
  CAST(CASE WHEN (o_custkey * 37) % 360 - 180 + 1 + o_orderkey % 9 > 180 THEN (o_custkey * 37) % 360 - 540 + 1 + o_orderkey % 9
       ELSE (o_custkey * 37) % 360 - 180 + 1 + o_orderkey % 9 END AS DOUBLE) AS east,
  CAST((o_orderkey * 17) % 160 - 80 + 1 + o_custkey % 7 AS DOUBLE) AS north,
  CASE WHEN o_orderkey % 23 = 0 THEN 'point' ELSE 'bbox' END AS geometry_kind,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST((o_custkey * 37) % 360 - 180 AS DOUBLE) END AS lon,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST((o_orderkey * 17) % 160 - 80 AS DOUBLE) END AS lat,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 101 AS DOUBLE) END AS cloud,
  o_orderkey % 29 = 0 AS footprint_is_request
FROM {{orders}}""",
    ),
    # One ring a nation, convex or not; some cross 180 degrees, their positions beyond it written as the other side's.
    "areas": (
        ("nation",),
        f"""SELECT CAST(n_nationkey AS BIGINT) AS area_id, {_RING} AS ring FROM {{nation}}""",
    ),
    "detections": (
        ("events",),
        """SELECT event_id AS ord, event_id, ts, user_id, event_type AS satellite,
  CAST((event_id * 7919) % 36000 - 18000 AS DOUBLE) / 100 AS lon, CAST((event_id * 5471 + user_id * 97) % 18000 - 9000 AS DOUBLE) / 100 AS lat,
  CAST(floor(value * 100) AS BIGINT) AS frp_cents, props
FROM {events}""",
    ),
    "stored": (
        ("events",),
        """SELECT event_id AS ord, concat('K', CAST(event_id AS STRING)) AS id, concat('c', CAST(user_id % 3 AS STRING)) AS collection, ts,
  CAST(user_id % 40 - 20 AS DOUBLE) AS west, CAST(user_id % 30 - 15 AS DOUBLE) AS south,
  CAST(user_id % 40 - 18 AS DOUBLE) AS east, CAST(user_id % 30 - 13 AS DOUBLE) AS north,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('T', CAST(user_id % 5 AS STRING)) END AS grid_key
FROM {events} WHERE event_id % 3 = 0""",
    ),
    "candidates": (
        ("events",),
        """SELECT event_id AS ord, concat('N', CAST(event_id AS STRING)) AS id, concat('c', CAST(user_id % 3 AS STRING)) AS collection, ts,
  CAST(user_id % 40 - 20 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 10 AS west, CAST(user_id % 30 - 15 AS DOUBLE) AS south,
  CAST(user_id % 40 - 18 AS DOUBLE) + CAST(event_id % 4 AS DOUBLE) / 10 AS east, CAST(user_id % 30 - 13 AS DOUBLE) AS north,
  concat('T', CAST(user_id % 5 AS STRING)) AS grid_key,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('05.', CAST(event_id % 12 AS STRING)) END AS baseline, ts AS stamp
FROM {events} WHERE event_id % 3 <> 0""",
    ),
    # Scenes 9 seconds apart over two places; a third of them are stored, a third new: each place is one long chain of claims.
    "kept": (
        ("events",),
        """SELECT event_id AS ord, concat('K', CAST(event_id AS STRING)) AS id, 'c' AS collection, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id * 9 + event_id % 7) AS ts,
  CAST(100 + event_id % 2 * 79 AS DOUBLE) AS west, CAST(-10 AS DOUBLE) AS south, CAST(102 + event_id % 2 * 79 - event_id % 2 * 360 AS DOUBLE) AS east, CAST(-8 AS DOUBLE) AS north,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('T', CAST(event_id % 2 AS STRING)) END AS grid_key
FROM {events} WHERE event_id % 3 = 0""",
    ),
    "renewed": (
        ("events",),
        """SELECT event_id AS ord, concat('N', CAST(event_id AS STRING)) AS id, 'c' AS collection, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (event_id * 9 + event_id % 11) AS ts,
  CAST(100 + event_id % 2 * 79 AS DOUBLE) + CAST(floor(event_id / 7) % 2 AS DOUBLE) / 8 AS west, CAST(-10 AS DOUBLE) AS south,
  CAST(102 + event_id % 2 * 79 - event_id % 2 * 360 AS DOUBLE) + CAST(floor(event_id / 7) % 2 AS DOUBLE) / 8 AS east, CAST(-8 AS DOUBLE) AS north, concat('T', CAST(event_id % 2 AS STRING)) AS grid_key,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('05.', CAST(event_id % 12 AS STRING)) END AS baseline, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * event_id AS stamp
FROM {events} WHERE event_id % 3 = 1""",
    ),
    "pixels": (
        ("lineitem",),
        """SELECT l_orderkey % 16 AS image, l_orderkey AS row, CAST(l_linenumber AS BIGINT) AS col,
  CAST((l_orderkey * 31 + l_linenumber * 7) % 256 AS INT) AS r, CAST((l_orderkey * 17 + l_linenumber * 59) % 256 AS INT) AS g,
  CAST((l_orderkey * 101 + l_linenumber * 13) % 256 AS INT) AS b,
  CAST((l_orderkey * 13 + l_linenumber * 101) % 10000 AS INT) AS red, CAST((l_orderkey * 29 + l_linenumber * 11) % 10000 AS INT) AS nir,
  CAST((l_orderkey * 7 + l_linenumber * 37) % 10000 AS INT) AS green,
  CASE WHEN l_orderkey % 50 = 0 THEN CAST((10000 - (l_orderkey * 29 + l_linenumber * 11) % 10000) % 10000 AS INT) ELSE CAST((l_orderkey * 3 + l_linenumber * 71) % 10000 AS INT) END AS swir22
FROM {lineitem}""",
    ),
    "assets": (
        ("part",),
        f"""SELECT p_partkey AS ord, concat('A', CAST(p_partkey % 701 AS STRING)) AS scene, concat('src', CAST(p_partkey % 701 % 5 AS STRING)) AS source, p_partkey AS pos,
  {_choice("p_partkey % 9", ["visual", "thumbnail", "B04", "scl", "reflectance_file", "product", "qa_pixel", "B8A", "cloud_mask"])} AS key,
  {_choice("p_partkey % 7", ["data", "thumbnail", "data,reflectance", "data", "metadata", "data,archive", "overview"])} AS roles,
  {_choice("p_partkey % 6", ["image/tiff; application=geotiff", "image/jpeg", "image/png", "application/zip", "image/tiff", "application/x-hdf"])} AS media_type,
  concat('https://example.com/', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 4 = 0 THEN '.tif' ELSE '.bin' END) AS href,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1048576 END AS size_bytes
FROM {{part}}""",
    ),
    "sources": (
        ("nation", "region"),
        """SELECT lower(n_name) AS source, lower(r_name) AS satellite,
  CASE n_nationkey % 4 WHEN 0 THEN 'optical' WHEN 1 THEN 'sar' WHEN 2 THEN 'dem' ELSE 'thermal' END AS kind, n_nationkey
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    ),
    "numbered": (("part",), "SELECT p_partkey AS n FROM {part}"),
    "usage": (
        ("conversations",),
        """SELECT conv_id, turn, role, text, length(text) AS chars, CAST(floor(length(text) / 4) AS BIGINT) AS tokens,
  concat('m', CAST(conv_id % 4 AS STRING)) AS model
FROM {conversations}""",
    ),
    "outcomes": (
        ("lineitem",),
        """SELECT concat('src', CAST(l_suppkey % 6 AS STRING)) AS source, concat('S', CAST(l_orderkey AS STRING)) AS id, CAST(l_linenumber AS BIGINT) AS ord,
  CASE WHEN l_suppkey % 6 = 5 THEN 'failed' WHEN (l_orderkey + l_linenumber) % 10 < 6 THEN 'saved' WHEN (l_orderkey + l_linenumber) % 10 < 8 THEN 'skipped'
       WHEN (l_orderkey + l_linenumber) % 10 = 8 THEN 'failed' ELSE 'no_asset' END AS status
FROM {lineitem}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables})


def oracle(names: str, body: str) -> str:
    """DuckDB SQL: the views named, then body, which is a query or goes on with `, name AS (...)`."""
    views = ",\n".join(f"{n} AS (\n{VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})}\n)" for n in names.split())
    views = views.replace("array(", "list_value(")
    return f"WITH {views}\n{body}"
