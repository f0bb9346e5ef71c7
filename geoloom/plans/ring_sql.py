"""SQL that holds every ring of `areas` (area_id, ring) against every box and point of `scenes`, edge by edge."""

#: Corners of each area with longitudes that run on, in order, and its edges and box.
EDGES = """, corners AS (SELECT area_id, unnest(ring) AS p, generate_subscripts(ring, 1) AS i FROM areas),
plane AS (SELECT area_id, i, p[2] AS y, CASE WHEN p[1] < first - 180 THEN p[1] + 360 WHEN p[1] > first + 180 THEN p[1] - 360 ELSE p[1] END AS x
  FROM corners JOIN (SELECT area_id, ring[1][1] AS first FROM areas) USING (area_id)),
edges AS (SELECT area_id, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM plane WINDOW o AS (PARTITION BY area_id ORDER BY i) QUALIFY x2 IS NOT NULL),
boxes AS (SELECT area_id, min(x) AS w, max(x) AS e, min(y) AS s, max(y) AS n, arg_min(x, i) AS first FROM plane GROUP BY area_id),
ringbox AS (SELECT *, CASE WHEN w < -180 THEN w + 360 ELSE w END AS rw, CASE WHEN e > 180 THEN e - 360 ELSE e END AS re, (w + e) / 2 AS middle FROM boxes)"""
#: A ring's box and another, either of which may cross 180 degrees.
_BOXES_MEET = """s <= north AND n >= south AND (
  (rw <= CASE WHEN west > east THEN 180 ELSE east END AND west <= CASE WHEN rw > re THEN 180 ELSE re END)
  OR (west > east AND rw <= east AND -180 <= CASE WHEN rw > re THEN 180 ELSE re END)
  OR (rw > re AND -180 <= CASE WHEN west > east THEN 180 ELSE east END AND west <= re) OR (rw > re AND west > east))"""
HITS = """, placed AS (SELECT area_id, ord, CASE WHEN west - middle > 180 THEN west - 360 WHEN middle - west > 180 THEN west + 360 ELSE west END AS bw, south AS bs, north AS bn,
    CASE WHEN west > east THEN east - west + 360 ELSE east - west END AS span
  FROM scenes JOIN ringbox ON """ + _BOXES_MEET + """ WHERE geometry_kind <> 'point'),
spots AS (SELECT area_id, ord, CASE WHEN lon - first > 180 THEN lon - 360 WHEN first - lon > 180 THEN lon + 360 ELSE lon END AS px, lat AS py
  FROM (SELECT ord, lon, lat, lon AS west, lon AS east, lat AS south, lat AS north FROM scenes WHERE geometry_kind = 'point') JOIN ringbox ON """ + _BOXES_MEET + """),
turned AS (SELECT p.*, x1, y1, x2, y2, (x2 - x1) * (bs - y1) - (y2 - y1) * (bw - x1) AS c1, (x2 - x1) * (bs - y1) - (y2 - y1) * (bw + span - x1) AS c2,
    (x2 - x1) * (bn - y1) - (y2 - y1) * (bw + span - x1) AS c3, (x2 - x1) * (bn - y1) - (y2 - y1) * (bw - x1) AS c4 FROM placed p JOIN edges USING (area_id)),
boxed AS (SELECT area_id, ord FROM turned GROUP BY area_id, ord
  HAVING bool_or(least(x1, x2) <= bw + span AND greatest(x1, x2) >= bw AND least(y1, y2) <= bn AND greatest(y1, y2) >= bs AND least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0)
    OR count(*) FILTER ((y1 > bs) <> (y2 > bs) AND bw < (x2 - x1) * (bs - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1),
spotted AS (SELECT area_id, ord FROM spots JOIN edges USING (area_id) GROUP BY area_id, ord
  HAVING bool_or(abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 1e-9 AND px BETWEEN least(x1, x2) - 1e-9 AND greatest(x1, x2) + 1e-9 AND py BETWEEN least(y1, y2) - 1e-9 AND greatest(y1, y2) + 1e-9)
    OR count(*) FILTER ((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1),
hits AS (SELECT * FROM boxed UNION ALL SELECT * FROM spotted)"""
