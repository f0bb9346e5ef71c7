"""Queries of pixels: calibration, indices, masks, classes, stretches, changes, blobs; each with its DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from geoloom.functions import spectral as R
from geoloom.operators import pixels as P
from geoloom.operators.network import Network, segmented
from geoloom.operators.quantiles import quantiles
from geoloom.plans.views import oracle, view
from geoloom.tables import read

RGB = ("r", "g", "b")


def _rgb():
    return tuple(F.col(c) for c in RGB)


def _pixels(spark, sf_dir):
    return view(spark, sf_dir, "pixels")


def _reflectance(spark, sf_dir):
    scale, offset = R.PRESETS["s2-l2a"]
    return _pixels(spark, sf_dir).select("image", "row", "col", *[R.calibrated(F.col(b), scale, offset, fill=0).alias(b) for b in ("red", "green", "nir", "swir22")])


def r01_calibrated(spark, sf_dir):
    return _reflectance(spark, sf_dir).select("row", "col", *[F.round(b, 6).alias(b) for b in ("red", "nir")])


def r02_boa_offset(spark, sf_dir):
    applied = F.element_at(F.array(F.lit(True), F.lit(False), F.lit(None)), (F.col("p_partkey") % 3 + 1).cast("int"))
    scale, offset = R.boa_calibration(applied, F.when(F.col("p_size") % 2 == 0, F.lit(0.002)), F.lit(-0.1))
    return read(spark, sf_dir, "part").select("p_partkey", scale.alias("scale"), offset.alias("offset"))


def r05_indices(spark, sf_dir):
    p = _reflectance(spark, sf_dir)
    return p.select("row", "col", *[F.round(c, 6).alias(n) for n, c in R.indices(p.columns).items()])


def a15_index_summary(spark, sf_dir):
    p = _reflectance(spark, sf_dir)
    ind = R.indices(p.columns)
    s = P.index_summary(p.select("image", *[c.alias(n) for n, c in ind.items()]), list(ind), ["image"])
    return s.select("image", *[F.round(c, 6).alias(c) if not c.endswith("count") else F.col(c) for c in s.columns if c != "image"])


def _mask(name):
    def query(spark, sf_dir):
        return P.spatial_stats(_pixels(spark, sf_dir), ["image"], R.MASKS[name](*_rgb()))

    return query


def r10_nearest_class(spark, sf_dir):
    return _pixels(spark, sf_dir).select("row", "col", R.nearest_class(*_rgb()).alias("label"))


def a12_class_fractions(spark, sf_dir):
    labelled = _pixels(spark, sf_dir).withColumn("label", R.nearest_class(*_rgb()))
    return P.class_fractions(labelled, "label", [c[0] for c in R.CENTROIDS], ["image"])


def r09_change_heat(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    before, after = p.filter("col = 1").select("row", *RGB), p.filter("col = 2").select("row", *RGB)
    return P.change(before, after, list(RGB), ["row"]).select("row", F.round("heat", 6).alias("heat"))


def a14_changed_fraction(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    h = P.change(p.filter("col = 1").select("image", "row", *RGB), p.filter("col = 2").select("image", "row", *RGB), list(RGB), ["image", "row"])
    return h.groupBy("image").agg(F.avg((F.col("heat") >= P.CHANGED).cast("double")).alias("changed"))


def a16_stretch_bounds(spark, sf_dir):
    b = P.stretch_bounds(_pixels(spark, sf_dir), ["red", "nir"], ["image"])
    return b.select("image", *[F.round(c, 6).alias(c) for c in b.columns if c != "image"])


def r08_preview(spark, sf_dir):
    return P.preview(_pixels(spark, sf_dir), ["red", "green"], ["image"]).groupBy("image").agg(
        *[f(c).cast("bigint").alias(f"{c}_{n}") for c in ("red", "green") for n, f in (("sum", F.sum), ("max", F.max), ("min", F.min))]
    )


#: Bands that aren't whole numbers, null in places.
FLOATS = {"ratio": "(nir - red) / nullif(CAST(nir + red - 9000 AS DOUBLE), 0)", "glow": "CASE WHEN row % 3 = 0 THEN 0.0 ELSE red * 1.0 / (green + 1.0) - 0.5 END"}


def _floats(spark, sf_dir):
    return _pixels(spark, sf_dir).select("image", "row", "col", *[F.expr(e).cast("double").alias(n) for n, e in FLOATS.items()])


def a16_float_bounds(spark, sf_dir):
    return P.stretch_bounds(_floats(spark, sf_dir), list(FLOATS), ["image"])


def a16_quantiles(spark, sf_dir):
    """Quantiles of prices by return flag, whatever their number."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x"))
    return quantiles(lines, ["l_returnflag"], [0.0, 0.013, 0.5, 0.98, 1.0])


def r08_subsampled_preview(spark, sf_dir):
    """A preview of every so many rows and columns, so that the longer side has at most 64."""
    packed = _floats(spark, sf_dir).withColumn("row", F.floor(F.col("row") / 16))
    small = P.subsampled(packed, ["image"], 64)
    shown = P.preview(small, ["ratio"], ["image"])
    return shown.groupBy("image").agg(F.count("*").alias("n"), F.sum(F.col("ratio").cast("bigint")).alias("sum"), F.max("row").alias("last"))


def r15_paired_bounds(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    b = P.paired_bounds(p.filter("image = 1"), p.filter("image = 2"), ["red"])
    return b.select(F.round(F.col("red")[0], 6).alias("low"), F.round(F.col("red")[1], 6).alias("high"))


def a18_centroids(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("label", (F.col("row") % 5).cast("int"))
    return P.centroids(p, "label", list(RGB)).select("label", *[F.round(c, 6).alias(c) for c in RGB])


def a19_head_weights(spark, sf_dir):
    p = _pixels(spark, sf_dir).withColumn("label", (F.col("row") % 5).cast("int"))
    w = P.head_weights(P.centroids(p, "label", list(RGB)), "label", list(RGB))
    return w.select("label", *[F.round(c, 6).alias(c) for c in w.columns if c != "label"])


def _raster(spark, sf_dir):
    """A raster of 64 columns: images of 64 by 64 pixels from the lineitems in order of their key."""
    n = F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4
    return read(spark, sf_dir, "lineitem").select(n.alias("n"), "l_quantity").groupBy("n").agg(F.sum("l_quantity").alias("value")).select(
        F.floor(F.col("n") / 4096).cast("bigint").alias("image"), (F.floor(F.col("n") / 64) % 64).cast("bigint").alias("row"), (F.col("n") % 64).cast("bigint").alias("col"), "value"
    )


def a20_blobs(spark, sf_dir):
    mask = _raster(spark, sf_dir).filter("value > 20").select("image", "row", "col")
    return P.blobs(mask, least=4).select("image", "area", "row0", "col0", "row1", "col1")


def a20_hulls(spark, sf_dir):
    """The corners of each patch's hull, from bands of eight rows."""
    mask = _raster(spark, sf_dir).filter("value > 20").select("image", "row", "col")
    found = P.hulls(mask, least=8, band=8, fan=2).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("points") - 1, F.lit(2))))
    return found.select("image", "place", "area", F.col("points")[F.col("i")].alias("x"), F.col("points")[F.col("i") + 1].alias("y"))


def r12_convolution(spark, sf_dir):
    out = P.convolved(_raster(spark, sf_dir), [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]], 0.5)
    return out.select("image", "row", "col", F.round("value", 6).alias("value"))


def r12_pool_and_skip(spark, sf_dir):
    """The way down and up again: pooled, convolved, doubled, added to what was there before."""
    x = _raster(spark, sf_dir)
    up = P.doubled(P.convolved(P.pooled(x), [[0.0, 0.25, 0.0], [0.25, 0.0, 0.25], [0.0, 0.25, 0.0]], 0.0))
    return x.join(up.withColumnRenamed("value", "up"), ["image", "row", "col"]).select("image", "row", "col", F.round(F.col("value") + F.col("up"), 6).alias("value"))


def _kernels(outputs: int, inputs: int, seed: int):
    """Kernels and biases by a rule, in eighths: sums of them are exact."""
    k = [[[[((o * 5 + i * 3 + a * 7 + b * 2 + seed) % 9 - 4) / 8 for b in range(3)] for a in range(3)] for i in range(inputs)] for o in range(outputs)]
    return np.array(k), np.array([((o + seed) % 5 - 2) / 8 for o in range(outputs)])


NETWORK = Network(_kernels(2, 2, 1), _kernels(2, 2, 4), _kernels(2, 4, 2), _kernels(3, 2, 5), np.array([2.0, 1.0]), np.array([4.0, 2.0]), 0.5)


def r12_forward_pass(spark, sf_dir):
    """Labels of a whole network over images of 64 by 64, in squares of 32."""
    x = _raster(spark, sf_dir).withColumn("other", (F.col("row") * 3 + F.col("col")) % 11)
    return segmented(x, ["value", "other"], NETWORK, side=32)


def _forward_sql() -> str:
    """The same layer by layer: neighbours by a join on clamped places, channels as columns."""

    def layer(source: str, name: str, inputs: list[str], kernel, bias, h: str, w: str, positive: bool) -> str:
        sums = []
        for o in range(len(bias)):
            terms = " + ".join(
                f"{i} * CASE {' '.join(f'WHEN d.a = {a} AND d.b = {b} THEN {kernel[o][n][a][b]}' for a in range(3) for b in range(3))} END" for n, i in enumerate(inputs)
            )
            sums.append(f"{'greatest(0, ' if positive else '('}{bias[o]} + sum({terms})) AS c{o}")
        return f"""{name}_near AS MATERIALIZED (SELECT p.image, p.row, p.col, d.a, d.b, least(greatest(p.row + d.a - 1, 0), {h} - 1) AS nr, least(greatest(p.col + d.b - 1, 0), {w} - 1) AS nc
  FROM {source} p JOIN sizes s USING (image) CROSS JOIN d),
{name} AS MATERIALIZED (SELECT d.image, d.row, d.col, {', '.join(sums)} FROM {name}_near d JOIN {source} n ON n.image = d.image AND n.row = d.nr AND n.col = d.nc GROUP BY ALL)"""

    full = ["s.h + s.h % 2", "s.w + s.w % 2"]
    half = [f"({x}) // 2" for x in full]
    parts = [
        "d AS (SELECT a, b FROM (SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b))",
        "sizes AS (SELECT image, max(row) + 1 AS h, max(col) + 1 AS w FROM raster GROUP BY image)",
        "places AS (SELECT image, h, w, row, unnest(range(w + w % 2)) AS col FROM (SELECT *, unnest(range(h + h % 2)) AS row FROM sizes))",
        """x AS MATERIALIZED (SELECT p.image, p.row, p.col, (coalesce(r.value, 0) * 0.5 - 2) / 4 AS u, (CASE WHEN r.value IS NULL THEN 0 ELSE (r.row * 3 + r.col) % 11 END * 0.5 - 1) / 2 AS v
  FROM places p LEFT JOIN raster r ON r.image = p.image AND r.row = least(p.row, p.h - 1) AND r.col = least(p.col, p.w - 1))""",
        layer("x", "e", ["n.u", "n.v"], *NETWORK.first, *full, True),
        "pool AS MATERIALIZED (SELECT image, row // 2 AS row, col // 2 AS col, max(c0) AS c0, max(c1) AS c1 FROM e GROUP BY ALL)",
        layer("pool", "mid", ["n.c0", "n.c1"], *NETWORK.middle, *half, True),
        "up AS MATERIALIZED (SELECT e.image, e.row, e.col, m.c0 AS m0, m.c1 AS m1, e.c0 AS e0, e.c1 AS e1 FROM e JOIN mid m ON m.image = e.image AND m.row = e.row // 2 AND m.col = e.col // 2)",
        layer("up", "dec", ["n.m0", "n.m1", "n.e0", "n.e1"], *NETWORK.joined, *full, True),
        layer("dec", "top", ["n.c0", "n.c1"], *NETWORK.head, *full, False),
    ]
    return _PIXEL + ", " + ",\n".join(parts) + """
SELECT image, row, col, CAST(CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INT) AS label FROM top JOIN raster USING (image, row, col)"""


_DN = "CASE WHEN {b} <> 0 THEN CAST({b} AS DOUBLE) * 1e-4 - 1e-1 END"
_REFL = "refl AS (SELECT image, row, col, " + ", ".join(f"{_DN.format(b=b)} AS {b}" for b in ("red", "green", "nir", "swir22")) + " FROM pixels)"
_ND = "({a} - {b}) / nullif({a} + {b}, 0)"
_IND = {"ndvi": ("nir", "red"), "ndwi_mcfeeters": ("green", "nir"), "nbr": ("nir", "swir22")}
_MASK_SQL = {
    "cloud": "(r + g + b) // 3 >= 200 AND greatest(r, g, b) - least(r, g, b) <= 25",
    "burn": "(299 * r + 587 * g + 114 * b) // 1000 BETWEEN 25 AND 79 AND r > g AND r > b AND g < 90",
    "water": "b > r + 30 AND b > g + 20 AND b >= 80",
}
_AWAY = [f"((r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}))" for _, r, g, b in R.CENTROIDS]
_NEAREST = f""", classes(i, class) AS (VALUES {", ".join(f"({i}, '{c[0]}')" for i, c in enumerate(R.CENTROIDS))}), away AS (SELECT *, [{", ".join(_AWAY)}] AS d FROM pixels),
near AS (SELECT image, row, col, list_position(d, list_min(d)) - 1 AS label FROM away)"""
_PIXEL = "WITH n AS (SELECT l_orderkey * 4 + l_linenumber % 4 AS n, sum(l_quantity) AS value FROM lineitem GROUP BY 1), raster AS (SELECT n // 4096 AS image, n // 64 % 64 AS row, n % 64 AS col, value FROM n)"
_BLOBS = _PIXEL.replace("WITH n", "WITH RECURSIVE n") + """, mask AS (SELECT image, row, col, image * 4096 + row * 64 + col AS id FROM raster WHERE value > 20),
reach(id, other) AS (SELECT id, id FROM mask UNION SELECT r.id, m.id FROM reach r JOIN mask o ON o.id = r.other JOIN mask m ON m.image = o.image AND abs(m.row - o.row) + abs(m.col - o.col) = 1),
named AS (SELECT id, min(other) AS blob FROM reach GROUP BY id)"""
_KNOWN = "CASE WHEN {b} <> 0 OR {b}_zeros <= 0.5 THEN CAST({b} AS DOUBLE) END"

QUERIES = {
    "r01_calibrated": (r01_calibrated, oracle("pixels", f", {_REFL} SELECT row, col, round(red, 6) AS red, round(nir, 6) AS nir FROM refl")),
    "r02_boa_offset": (r02_boa_offset, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.002 ELSE 0.0001 END AS scale, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE -0.1 END AS offset FROM part"),
    "r05_indices": (
        r05_indices,
        oracle("pixels", f", {_REFL} SELECT row, col, " + ", ".join(f"round({_ND.format(a=a, b=b)}, 6) AS {n}" for n, (a, b) in _IND.items()) + " FROM refl"),
    ),
    "a15_index_summary": (
        a15_index_summary,
        oracle("pixels", f", {_REFL}, ind AS (SELECT image, " + ", ".join(f"{_ND.format(a=a, b=b)} AS {n}" for n, (a, b) in _IND.items()) + " FROM refl) SELECT image, "
               + ", ".join(f"round(min({n}), 6) AS {n}_min, round(max({n}), 6) AS {n}_max, count({n}) AS {n}_count" for n in _IND) + " FROM ind GROUP BY image"),
    ),
    **{
        f"{'r06' if m == 'cloud' else 'r07'}_{m}_mask": (_mask(m), oracle("pixels", f"SELECT image, avg(CASE WHEN {w} THEN 1.0 ELSE 0.0 END) AS fraction, count(*) AS n FROM pixels GROUP BY image"))
        for m, w in _MASK_SQL.items()
    },
    "r10_nearest_class": (r10_nearest_class, oracle("pixels", _NEAREST + "SELECT row, col, CAST(label AS INT) AS label FROM near")),
    "a12_class_fractions": (
        a12_class_fractions,
        oracle("pixels", _NEAREST + """, t AS (SELECT image, count(*) AS n FROM pixels GROUP BY image)
SELECT t.image, c.class, count(near.label) AS n, count(near.label) / any_value(t.n) AS fraction FROM t CROSS JOIN classes c LEFT JOIN near ON near.image = t.image AND near.label = c.i GROUP BY t.image, c.class"""),
    ),
    "r09_change_heat": (
        r09_change_heat,
        oracle("pixels", "SELECT a.row, round((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 765.0, 6) AS heat FROM pixels a JOIN pixels b ON a.row = b.row WHERE a.col = 1 AND b.col = 2"),
    ),
    "a14_changed_fraction": (
        a14_changed_fraction,
        oracle("pixels", "SELECT a.image, avg(CASE WHEN (abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 765.0 >= 0.2 THEN 1.0 ELSE 0.0 END) AS changed FROM pixels a JOIN pixels b ON a.row = b.row WHERE a.col = 1 AND b.col = 2 GROUP BY a.image"),
    ),
    "a16_stretch_bounds": (
        a16_stretch_bounds,
        oracle("pixels", f""", z AS (SELECT image, count(*) FILTER (red = 0) / count(*) AS red_zeros, count(*) FILTER (nir = 0) / count(*) AS nir_zeros FROM pixels GROUP BY image),
k AS (SELECT image, red_zeros, nir_zeros, {_KNOWN.format(b='red')} AS red, {_KNOWN.format(b='nir')} AS nir FROM pixels JOIN z USING (image))
SELECT image, round(quantile_cont(red, 0.02), 6) AS red_low, round(quantile_cont(red, 0.98), 6) AS red_high, round(quantile_cont(nir, 0.02), 6) AS nir_low, round(quantile_cont(nir, 0.98), 6) AS nir_high,
  round(any_value(red_zeros), 6) AS red_zeros, round(any_value(nir_zeros), 6) AS nir_zeros FROM k GROUP BY image"""),
    ),
    "r08_preview": (
        r08_preview,
        oracle("pixels", """, q AS (SELECT image, quantile_cont(CAST(red AS DOUBLE), 0.02) AS rl, quantile_cont(CAST(red AS DOUBLE), 0.98) AS rh, quantile_cont(CAST(green AS DOUBLE), 0.02) AS gl, quantile_cont(CAST(green AS DOUBLE), 0.98) AS gh FROM pixels GROUP BY image),
s AS (SELECT image, CAST(round_even(least(greatest((red - rl) / (rh - rl), 0), 1) * 255, 0) AS BIGINT) AS red, CAST(round_even(least(greatest((green - gl) / (gh - gl), 0), 1) * 255, 0) AS BIGINT) AS green FROM pixels JOIN q USING (image))
SELECT image, CAST(sum(red) AS BIGINT) AS red_sum, max(red) AS red_max, min(red) AS red_min, CAST(sum(green) AS BIGINT) AS green_sum, max(green) AS green_max, min(green) AS green_min FROM s GROUP BY image"""),
    ),
    "a16_float_bounds": (
        a16_float_bounds,
        oracle("pixels", f""", f AS (SELECT image, {FLOATS['ratio']} AS ratio, {FLOATS['glow']} AS glow FROM pixels),
z AS (SELECT image, count(*) FILTER (ratio = 0) / count(ratio) AS ratio_zeros, count(*) FILTER (glow = 0) / count(glow) AS glow_zeros FROM f GROUP BY image),
k AS (SELECT image, ratio_zeros, glow_zeros, CASE WHEN ratio <> 0 OR ratio_zeros <= 0.5 THEN ratio END AS ratio, CASE WHEN glow <> 0 OR glow_zeros <= 0.5 THEN glow END AS glow FROM f JOIN z USING (image))
SELECT image, quantile_cont(ratio, 0.02) AS ratio_low, quantile_cont(ratio, 0.98) AS ratio_high, quantile_cont(glow, 0.02) AS glow_low, quantile_cont(glow, 0.98) AS glow_high,
  any_value(ratio_zeros) AS ratio_zeros, any_value(glow_zeros) AS glow_zeros FROM k GROUP BY image"""),
    ),
    "a16_quantiles": (
        a16_quantiles,
        "SELECT l_returnflag, p, quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.0, 0.013, 0.5, 0.98, 1.0])[i] AS value FROM lineitem, (SELECT unnest([0.0, 0.013, 0.5, 0.98, 1.0]::DOUBLE[]) AS p, unnest(range(1, 6)) AS i) GROUP BY l_returnflag, p, i",
    ),
    "r08_subsampled_preview": (
        r08_subsampled_preview,
        oracle("pixels", f""", packed AS (SELECT * REPLACE (row // 16 AS row) FROM pixels), size AS (SELECT image, min(row) AS row0, min(col) AS col0, greatest(1, ceil((greatest(max(row) - min(row), max(col) - min(col)) + 1) / 64)) AS step FROM packed GROUP BY image),
small AS (SELECT image, row, {FLOATS['ratio']} AS ratio FROM packed JOIN size USING (image) WHERE (row - row0) % step = 0 AND (col - col0) % step = 0),
q AS (SELECT image, quantile_cont(ratio, 0.02) AS lo, quantile_cont(ratio, 0.98) AS hi FROM small GROUP BY image)
SELECT image, count(*) AS n, CAST(sum(coalesce(round_even(least(greatest((ratio - lo) / (hi - lo), 0), 1) * 255, 0), 0)) AS BIGINT) AS sum, max(row) AS last FROM small JOIN q USING (image) GROUP BY image"""),
    ),
    "r15_paired_bounds": (
        r15_paired_bounds,
        oracle("pixels", "SELECT round(quantile_cont(CAST(red AS DOUBLE), 0.02), 6) AS low, round(quantile_cont(CAST(red AS DOUBLE), 0.98), 6) AS high FROM pixels WHERE image IN (1, 2)"),
    ),
    "a18_centroids": (
        a18_centroids,
        oracle("pixels", ", per AS (SELECT row % 5 AS label, image, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY ALL) SELECT CAST(label AS INT) AS label, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM per GROUP BY label"),
    ),
    "a19_head_weights": (
        a19_head_weights,
        oracle("pixels", """, per AS (SELECT row % 5 AS label, image, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY ALL), m AS (SELECT label, avg(r) / 255 AS r, avg(g) / 255 AS g, avg(b) / 255 AS b FROM per GROUP BY label)
SELECT CAST(label AS INT) AS label, round(2 * r, 6) AS w_r, round(2 * g, 6) AS w_g, round(2 * b, 6) AS w_b, round(-(r * r + g * g + b * b), 6) AS bias FROM m"""),
    ),
    "a20_blobs": (
        a20_blobs,
        _BLOBS + """
SELECT image, count(*) AS area, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1 FROM mask JOIN named USING (id) GROUP BY image, blob HAVING count(*) >= 4""",
    ),
    # A corner begins an edge: all other ends lie to one side of it, or between its two.
    "a20_hulls": (
        a20_hulls,
        _BLOBS + """, sizes AS (SELECT image, blob, count(*) AS area FROM mask JOIN named USING (id) GROUP BY ALL HAVING count(*) >= 8),
ends AS MATERIALIZED (SELECT DISTINCT image, blob, x, row AS y FROM (SELECT image, blob, row, unnest([min(col), max(col)]) AS x FROM mask JOIN named USING (id) JOIN sizes USING (image, blob) GROUP BY image, blob, row)),
sides AS (SELECT image, blob, p.x, p.y, q.x AS qx, q.y AS qy FROM ends p JOIN ends q USING (image, blob) JOIN ends r USING (image, blob) WHERE p.x <> q.x OR p.y <> q.y GROUP BY ALL
  HAVING bool_and((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) > 0 OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND r.x BETWEEN least(p.x, q.x) AND greatest(p.x, q.x) AND r.y BETWEEN least(p.y, q.y) AND greatest(p.y, q.y)))),
corners AS (SELECT DISTINCT image, blob, x, y FROM sides),
firsts AS (SELECT image, blob, min((x, y)) AS f FROM corners GROUP BY ALL HAVING count(*) >= 3),
placed AS (SELECT image, blob, area, row_number() OVER (PARTITION BY image ORDER BY area DESC, f[1], f[2]) AS place FROM firsts JOIN sizes USING (image, blob))
SELECT image, CAST(place AS INT) AS place, area, x, y FROM corners JOIN placed USING (image, blob)""",
    ),
    "r12_convolution": (
        r12_convolution,
        _PIXEL + """ SELECT a.image, a.row, a.col, round(greatest(0, 0.5 + coalesce(sum(CASE WHEN b.row = a.row AND b.col = a.col THEN -4 * b.value ELSE b.value END), 0)), 6) AS value
FROM raster a JOIN raster b ON a.image = b.image AND abs(a.row - b.row) + abs(a.col - b.col) <= 1 GROUP BY a.image, a.row, a.col""",
    ),
    "r12_forward_pass": (r12_forward_pass, _forward_sql()),
    "r12_pool_and_skip": (
        r12_pool_and_skip,
        _PIXEL + """, pool AS (SELECT image, row // 2 AS row, col // 2 AS col, max(value) AS value FROM raster GROUP BY ALL),
conv AS (SELECT a.image, a.row, a.col, coalesce(sum(b.value) / 4, 0) AS value FROM pool a LEFT JOIN pool b ON a.image = b.image AND abs(a.row - b.row) + abs(a.col - b.col) = 1 GROUP BY a.image, a.row, a.col)
SELECT r.image, r.row, r.col, round(r.value + c.value, 6) AS value FROM raster r JOIN conv c ON c.image = r.image AND c.row = r.row // 2 AND c.col = r.col // 2""",
    ),
}
