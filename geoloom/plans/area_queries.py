"""Queries of many areas at once: rings from nation, scenes from orders, detections from events; each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.operators import areas as A
from geoloom.operators import layout
from geoloom.plans.ring_sql import EDGES, HITS
from geoloom.plans.scene_queries import DATELINE, END, IN_DAYS, MEETS_DATELINE, START
from geoloom.plans.views import oracle, view
from geoloom.request import PullRequest
from geoloom.tables import shared_dir


def j04_areas_meet_scenes(spark, sf_dir):
    return A.overlapping(A.ringed(view(spark, sf_dir, "areas")), view(spark, sf_dir, "scenes"))


def f05_areas_hold_detections(spark, sf_dir):
    found = A.containing(A.ringed(view(spark, sf_dir, "areas")), view(spark, sf_dir, "detections"))
    return found.withColumnRenamed("ord", "event_id")


def j04_scenes_per_area(spark, sf_dir):
    """What each area would get from each source."""
    scenes = view(spark, sf_dir, "scenes")
    hits = A.overlapping(A.ringed(view(spark, sf_dir, "areas")), scenes)
    return hits.join(scenes, "ord").groupBy("area_id", "source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("ts").alias("newest"))


def g11_split_rings(spark, sf_dir):
    """Square degrees of each area's pieces, on either side of 180 degrees where it crosses it."""
    pieces = A.split(view(spark, sf_dir, "areas")).withColumn("area", A.ring_area(F.col("ring")))
    west = F.array_min(F.transform("ring", lambda p: p[0])) <= -180
    crossing = F.count("*").over(_by_area()) > 1
    return pieces.withColumn("side", F.when(crossing & west, "east").otherwise("west")).groupBy("area_id", "side").agg(F.round(F.sum("area"), 6).alias("area"))


def f08_pruned_search(spark, sf_dir):
    """A request's scenes from the table by month and curve, by source and month."""
    at = f"{shared_dir(spark)}/scenes-{uuid.uuid4().hex}"
    layout.write(view(spark, sf_dir, "scenes"), at)
    found = layout.search(spark, at, PullRequest(START, END, DATELINE))
    return found.groupBy("source", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("ord").alias("sum_ord"))


def _by_area():
    from pyspark.sql import Window

    return Window.partitionBy("area_id")


_POINTS = """, scenes AS (SELECT ord, lon, lat, 'point' AS geometry_kind, lon AS west, lon AS east, lat AS south, lat AS north FROM detections)"""

QUERIES = {
    "f08_pruned_search": (
        f08_pruned_search,
        oracle("scenes", f" SELECT source, strftime(ts, '%Y-%m') AS month, count(*) AS n, CAST(sum(ord) AS BIGINT) AS sum_ord FROM scenes WHERE {IN_DAYS} AND {MEETS_DATELINE} GROUP BY ALL"),
    ),
    "j04_areas_meet_scenes": (j04_areas_meet_scenes, oracle("areas scenes", EDGES + HITS + " SELECT area_id, ord FROM hits")),
    "f05_areas_hold_detections": (f05_areas_hold_detections, oracle("areas detections", _POINTS + EDGES + HITS + " SELECT area_id, ord AS event_id FROM hits")),
    "j04_scenes_per_area": (
        j04_scenes_per_area,
        oracle("areas scenes", EDGES + HITS + " SELECT area_id, source, count(*) AS n, count(DISTINCT id) AS ids, max(ts) AS newest FROM hits JOIN scenes USING (ord) GROUP BY ALL"),
    ),
    # The part of each edge on a side of the meridian, times its distance from it: the area between ring and meridian.
    "g11_split_rings": (
        g11_split_rings,
        oracle("areas", EDGES + """, cuts AS (SELECT *, CASE WHEN e > 180 THEN 180 WHEN w < -180 THEN -180 ELSE 1000 END AS m FROM edges JOIN boxes USING (area_id)),
ends AS (SELECT *, CASE WHEN (x1 > m) <> (x2 > m) THEN y1 + (y2 - y1) * (m - x1) / (x2 - x1) END AS ym FROM cuts),
sides AS (SELECT area_id, 'west' AS side, m, sum(CASE WHEN x1 <= m AND x2 <= m THEN (x1 + x2 - 2 * m) * (y2 - y1) WHEN x1 <= m THEN (x1 - m) * (ym - y1) WHEN x2 <= m THEN (x2 - m) * (y2 - ym) ELSE 0 END) / 2 AS area FROM ends GROUP BY ALL
  UNION ALL SELECT area_id, 'east', m, sum(CASE WHEN x1 > m AND x2 > m THEN (x1 + x2 - 2 * m) * (y2 - y1) WHEN x1 > m THEN (x1 - m) * (ym - y1) WHEN x2 > m THEN (x2 - m) * (y2 - ym) ELSE 0 END) / 2 FROM ends GROUP BY ALL)
SELECT area_id, side, round(abs(area), 6) AS area FROM sides WHERE abs(area) > 1e-9"""),
    ),
}
