"""Rasters as rows of pixels (image, row, col, bands): statistics, stretches, classes, and blobs of a mask."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geoloom.functions import spectral
from geoloom.operators.graph import components
from geoloom.operators.quantiles import quantiles
from geoloom.tables import cut, join_checked

#: Percentiles of a stretch; share of zeros from which zero is nodata; heat of a change; least pixels of a blob.
LOW, HIGH, ZERO_SHARE, CHANGED, LEAST_BLOB = 0.02, 0.98, 0.5, 0.2, 16
#: Rows or columns of a preview at most.
MOST_SIDE = 2048


def index_summary(pixels: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Least, largest and number of known values of each index by key."""
    return pixels.groupBy(*keys).agg(*[f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max), ("count", F.count))])


def class_fractions(labels: DataFrame, label: str, names: list[str], keys: list[str]) -> DataFrame:
    """keys, class, n, fraction of all classes, those without pixels too."""
    n = labels.groupBy(*keys).agg(F.count("*").alias("_all"), *[F.count_if(F.col(label) == i).alias(f"_n{i}") for i in range(len(names))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_n{i}").alias("n")) for i, c in enumerate(names)])).alias("r")
    return n.select(*keys, "_all", rows).select(*keys, "r.class", "r.n", (F.col("r.n") / F.col("_all")).alias("fraction"))


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _bounds_of(known: DataFrame, bands: list[str], keys: list[str], value) -> DataFrame:
    """keys and low and high of each band (NAME_low, NAME_high): bands of whole numbers by counts of their values, others
    by quantiles that never hold a key's values together."""
    kinds = dict(known.dtypes)
    whole, others = [b for b in bands if kinds[b] in _WHOLE], [b for b in bands if kinds[b] not in _WHOLE]
    at = F.array(F.lit(LOW), F.lit(HIGH))
    g = known.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.percentile(value(b), at).alias(f"_p_{b}") for b in whole])
    g = g.select(*keys, *[F.col(f"_p_{b}")[i].alias(f"{b}_{n}") for b in whole for i, n in ((0, "low"), (1, "high"))])
    if not others:
        return g
    long = known.select(*keys, F.inline(F.array(*[F.struct(F.lit(b).alias("_band"), value(b).alias("x")) for b in others])))
    q = quantiles(long, [*keys, "_band"], [LOW, HIGH])
    own = lambda b, p: F.max(F.when((F.col("_band") == b) & (F.col("p") == p), F.col("value")))
    q = q.groupBy(*keys).agg(*[own(b, p).alias(f"{b}_{n}") for b in others for p, n in ((LOW, "low"), (HIGH, "high"))])
    alike = [g[k].eqNullSafe(q[k]) for k in keys]
    return (g.join(q, alike, "left") if keys else g.crossJoin(q)).select(*[g[k] for k in keys], *[f"{b}_{n}" for b in bands for n in ("low", "high")])


def stretch_bounds(pixels: DataFrame, bands: list[str], keys: list[str], exact: bool = True) -> DataFrame:
    """low and high of each band by key: percentiles of its known values; zero is nodata where over half are zero.

    exact: by counts of distinct values or by refined histograms; else by a sketch."""
    share = pixels.groupBy(*keys).agg(*[(F.count_if(F.col(b) == 0) / F.count(b)).alias(f"{b}_zeros") for b in bands])
    known = pixels.join(share, keys)
    value = lambda b: F.when((F.col(b) != 0) | (F.col(f"{b}_zeros") <= ZERO_SHARE), F.col(b).cast("double"))
    names = [f"{b}_{n}" for b in bands for n in ("low", "high")]
    if exact:
        return _bounds_of(known, bands, keys, value).join(share, keys).select(*keys, *names, *[f"{b}_zeros" for b in bands])
    g = known.groupBy(*keys).agg(*[F.percentile_approx(value(b), [LOW, HIGH], 10_000).alias(f"_p_{b}") for b in bands], *[F.first(f"{b}_zeros").alias(f"{b}_zeros") for b in bands])
    return g.select(*keys, *[F.col(f"_p_{b}")[i].alias(f"{b}_{n}") for b in bands for i, n in ((0, "low"), (1, "high"))], *[f"{b}_zeros" for b in bands])


def subsampled(pixels: DataFrame, keys: list[str], most: int = MOST_SIDE) -> DataFrame:
    """Every so many rows and columns of each image, counted from its first, that its longer side has at most so many."""
    size = pixels.groupBy(*keys).agg(F.min("row").alias("_r"), F.min("col").alias("_c"), (F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")) + 1).alias("_side"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_side") / most))
    kept = join_checked(pixels, size.withColumn("_step", step), keys)
    return kept.filter(((F.col("row") - F.col("_r")) % F.col("_step") == 0) & ((F.col("col") - F.col("_c")) % F.col("_step") == 0)).select(pixels.columns)


def preview(pixels: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """Bands stretched to 0..255 between their percentiles; nodata is 0."""
    bounds = stretch_bounds(pixels, bands, keys)
    b = lambda c: F.when((F.col(c) != 0) | (F.col(f"{c}_zeros") <= ZERO_SHARE), F.col(c).cast("double"))
    shown = [spectral.stretched(b(c), F.col(f"{c}_low"), F.col(f"{c}_high")).alias(c) for c in bands]
    return pixels.join(bounds, keys).select(*keys, *[c for c in ("row", "col") if c not in keys], *shown)


def paired_bounds(before: DataFrame, after: DataFrame, bands: list[str]) -> DataFrame:
    """One range (low, high) a band for two images, so that both are stretched alike."""
    both = before.select(*bands).unionByName(after.select(*bands))
    found = _bounds_of(both, bands, [], lambda b: F.col(b).cast("double"))
    return found.select(*[F.array(f"{b}_low", f"{b}_high").alias(b) for b in bands])


def centroids(pixels: DataFrame, label: str, bands: list[str]) -> DataFrame:
    """Mean colour of each class: the mean of its images' means, so that a large image weighs no more than a small one."""
    per = pixels.groupBy(label, "image").agg(*[F.avg(b).alias(b) for b in bands])
    return per.groupBy(label).agg(*[F.avg(b).alias(b) for b in bands])


def head_weights(means: DataFrame, label: str, bands: list[str]) -> DataFrame:
    """Linear scores whose largest names the nearest mean: weights twice the mean, bias less its squared length."""
    m = [F.col(b) / 255.0 for b in bands]
    return means.select(label, *[(2 * x).alias(f"w_{b}") for x, b in zip(m, bands, strict=True)], (-sum((x * x for x in m), F.lit(0.0))).alias("bias"))


def change(before: DataFrame, after: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """keys and heat of pixels that both images have."""
    a = before.select(*keys, *[F.col(b).alias(f"_a{b}") for b in bands])
    both = a.join(after.select(*keys, *[F.col(b).alias(f"_b{b}") for b in bands]), keys)
    return both.select(*keys, spectral.change_heat(tuple(F.col(f"_a{b}") for b in bands), tuple(F.col(f"_b{b}") for b in bands)).alias("heat"))


#: Pixels along a side of the squares that patches are found in; rows that a task writes at once.
PATCH_SIDE, WRITTEN = 256, 10_000


def _linked(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes can reach: roots hang on lesser roots until the links agree."""
    root = np.arange(n)
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return root


def _in_square(row: np.ndarray, col: np.ndarray, side: int, band: int | None, least: int) -> Iterator[tuple]:
    """row and column of a patch's first pixel, band, area, box, hull's corners (if there are bands) and pixels on the
    square's edge, of the part that each patch of a square has in each band of rows. Small ones off the edge are left out."""
    at = np.lexsort((col, row))
    row, col = row[at], col[at]
    starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(col) != 1)])
    r, c0, c1 = row[starts], col[starts], col[np.r_[starts[1:], len(col)] - 1]
    # Runs that share a column with one of the row above.
    place = lambda r, c: (r - row[0]) * (2 * side) + c - col.min()
    low, high = np.searchsorted(place(r, c1), place(r + 1, c0)), np.searchsorted(place(r, c0), place(r + 1, c1), "right")
    n = high - low
    root = _linked(len(r), np.repeat(np.arange(len(r)), n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n))
    size = np.bincount(root, c1 - c0 + 1, len(r))
    rim = (r % side == 0) | (r % side == side - 1) | (c0 % side == 0) | (c1 % side == side - 1)
    kept = ((size >= least) | (np.bincount(root, rim, len(r)) > 0))[root]
    first_row, first_col = r[root], c0[root]
    part = np.zeros_like(r) if band is None else r // band
    at = np.flatnonzero(kept)
    at = at[np.lexsort((at, part[at], root[at]))]
    if not len(at):
        return
    cuts = np.flatnonzero(np.r_[True, (np.diff(root[at]) != 0) | (np.diff(part[at]) != 0)])
    r, c0, c1, rim = r[at], c0[at], c1[at], rim[at]
    told = [x.tolist() for x in (first_row[at][cuts], first_col[at][cuts], part[at][cuts], np.add.reduceat(c1 - c0 + 1, cuts), r[cuts], np.minimum.reduceat(c0, cuts), np.maximum.reduceat(r, cuts), np.maximum.reduceat(c1, cuts))]
    touch, ends = np.add.reduceat(rim, cuts, dtype=int).tolist(), [*cuts[1:].tolist(), len(r)]
    for low, high, touches, one in zip(cuts.tolist(), ends, touch, zip(*told, strict=True), strict=True):
        own = list(zip(r[low:high].tolist(), c0[low:high].tolist(), c1[low:high].tolist(), strict=True))
        edge = [x for y, a, b in own for c in (range(a, b + 1) if y % side in (0, side - 1) else {a, b}) if y % side in (0, side - 1) or c % side in (0, side - 1) for x in (y, c)] if touches else []
        yield *one, [] if band is None else _corners(p for y, a, b in own for p in ((a, y), (b, y))), edge


def _patches(mask: DataFrame, least: int, band: int | None = None, side: int = PATCH_SIDE) -> DataFrame:
    """image, blob, part (the band of rows), area, row0, col0, row1, col1, points (the corners of a hull, if there are bands):
    the parts of the patches of a mask, to be put together by blob.

    Patches are found square by square; only what lies on both sides of a square's edge is linked by Spark jobs, so rounds
    have links as long as the edges, and none where an image lies in one square."""
    image = mask.schema["image"].dataType.simpleString()
    square = [F.floor(F.col(c) / side).cast("bigint").alias(k) for c, k in (("row", "_r"), ("col", "_c"))]
    placed = mask.filter("row IS NOT NULL AND col IS NOT NULL").select("image", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    placed = placed.select("*", *square).repartition("image", "_r", "_c").distinct()
    names = ["image", "first_row", "first_col", "part", "area", "row0", "col0", "row1", "col1", "points", "edge"]
    kinds = [placed.schema["image"].dataType, *[T.LongType()] * 8, *[T.ArrayType(T.LongType())] * 2]
    schema = to_arrow_schema(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))

    def one(key: tuple, square: pa.Table) -> pa.Table:
        found = list(_in_square(*(square.column(c).to_numpy() for c in ("row", "col")), side, band, least))
        rows = list(zip(*found, strict=True)) or [()] * 10
        return pa.Table.from_arrays([pa.repeat(pa.scalar(key[0].as_py(), schema[0].type), len(found)), *[pa.array(x, f.type) for x, f in zip(rows, list(schema)[1:], strict=True)]], schema=schema)

    told = f"image {image}, " + ", ".join(f"{n} bigint" for n in names[1:-2]) + ", points array<bigint>, edge array<bigint>"
    parts = placed.groupBy("image", "_r", "_c").applyInArrow(one, told)
    parts = cut(parts.select("image", F.xxhash64("image", "first_row", "first_col").alias("id"), *names[3:]), "patches")
    at = F.explode(F.sequence(F.lit(0), F.size("edge") - 1, F.lit(2))).alias("_i")
    rim = parts.filter(F.size("edge") > 0).select("image", "id", "edge", at).select("image", "id", F.col("edge")[F.col("_i")].alias("row"), F.col("edge")[F.col("_i") + 1].alias("col"))
    last = lambda c: F.pmod(F.col(c), F.lit(side)) == side - 1
    over = rim.filter(last("col")).withColumn("col", F.col("col") + 1).union(rim.filter(last("row")).withColumn("row", F.col("row") + 1))
    links = over.withColumnRenamed("id", "u").join(rim.withColumnRenamed("id", "v").hint("merge"), ["image", "row", "col"]).select("u", "v")
    named = join_checked(parts, components(links).withColumnRenamed("node", "id"), ["id"], "left")
    return named.select("image", F.coalesce("root", "id").alias("blob"), *names[3:-1])


def blobs(mask: DataFrame, least: int = LEAST_BLOB) -> DataFrame:
    """image, blob, area, row0, col0, row1, col1 of the 4-connected patches of a mask (image, row, col), of `least` pixels
    or more."""
    g = _patches(mask, least).groupBy("image", "blob").agg(F.sum("area").alias("area"), F.min("row0").alias("row0"), F.min("col0").alias("col0"), F.max("row1").alias("row1"), F.max("col1").alias("col1"))
    return g.filter(F.col("area") >= least)


#: Rows of a band that hulls begin with, and hulls merged into one at each step.
BAND, FAN = 512, 16
_HULLS = pa.schema([("blob", pa.int64()), ("part", pa.int64()), ("area", pa.int64()), ("points", pa.list_(pa.int64()))])


def hulls(mask: DataFrame, least: int = LEAST_BLOB, band: int = BAND, fan: int = FAN) -> DataFrame:
    """image, place, area and the convex hull (an array of col, row) of every patch that has one, the largest first.

    Hulls begin in squares, by bands of rows, and are merged, so many at a time, until a patch has one. A step is one pass
    over sorted rows, in which a task holds the corners of a few hulls, whatever the patch and however many there are."""
    found = _patches(mask, least, band).select("image", "blob", "part", "area", "points")
    low, high = found.agg(F.min("part"), F.max("part")).first()
    bands = 1 if low is None else high - low + 1
    found = found.withColumn("part", F.col("part") - F.lit(low or 0))
    kind = to_arrow_schema(found.select("image").schema)[0]
    schema = pa.schema([kind, *_HULLS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in batch.slice(low, 1000).columns), strict=True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, own in groupby(rows(batches), key=lambda r: r[:3]):
            _, _, _, area, points = next(own)
            more = list(own)
            if more:
                area += sum(r[3] for r in more)
                points = _corners(p for flat in (points, *(r[4] for r in more)) for p in zip(flat[::2], flat[1::2], strict=True))
            out.append((*key, area, points))
            if len(out) >= WRITTEN:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    key = ["image", "blob", "part"]
    while True:
        # The last step leaves one hull a patch, also of those that several squares have parts of.
        bands = -(-bands // fan)
        found = found.withColumn("part", F.floor(F.col("part") / fan)).repartition(*key).sortWithinPartitions(*key).mapInArrow(merged, found.schema)
        if bands == 1:
            break
    # A hull of two corners has no inside.
    found = found.filter((F.size("points") >= 6) & (F.col("area") >= least))
    order = W.partitionBy("image").orderBy(F.col("area").desc(), F.col("points")[0], F.col("points")[1])
    return found.select("image", F.row_number().over(order).alias("place"), "area", "points")


def _corners(points: Iterable[tuple[int, int]]) -> list[int]:
    """The corners (x, y, x, y, ...) of points' hull, from the least on, in the order in which x turns to y."""
    points = sorted(set(points))
    return [x for p in (_half(points) + _half(points[::-1]) if len(points) > 1 else points) for x in p]


def _half(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """One side of a hull, without its last point: from each corner on, only turns to the left."""
    side: list[tuple[int, int]] = []
    for p in points:
        while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
            side.pop()
        side.append(p)
    return side[:-1]


def spatial_stats(pixels: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg(value.cast("double")).alias("fraction"), F.count("*").alias("n"))


#: Pixels along a side of the squares that layers are worked out in.
SIDE = 256


def layer(
    tiles: DataFrame, kernels: list, biases: list[float], inputs: list[str], outputs: list[str], image: str = "image", side: int = SIDE, positive: bool = True
) -> DataFrame:
    """image, row, col and outputs of a layer of 3x3 convolutions of (image, row, col, inputs): kernels by output, input, row
    and column. What is no pixel counts as zero and stays none; negative sums become 0 if only positive ones are wanted.

    Pixels go to squares, those on a square's edge to its neighbours too, so one shuffle of little over all pixels makes a
    layer, whatever its channels; a square is a task's work in arrays, bounded by its side."""
    k, bias = np.array(kernels, float).reshape(len(outputs), len(inputs), 3, 3), np.array(biases, float)
    near = lambda c: F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor((F.col(c) + d) / side))))
    held = tiles.select(image, "row", "col", *inputs, near("row").alias("_r")).select("*", near("col").alias("_c"))
    schema = f"{image} {tiles.schema[image].dataType.simpleString()}, row bigint, col bigint, " + ", ".join(f"{x} double" for x in outputs)

    def one(df: pd.DataFrame) -> pd.DataFrame:
        row, col = (df[c].to_numpy() - df[t].iloc[0] * side + 1 for c, t in (("row", "_r"), ("col", "_c")))
        grid = np.zeros((len(inputs), side + 2, side + 2))
        np.add.at(grid, (slice(None), row, col), df[inputs].to_numpy(float).T)
        sums = np.broadcast_to(bias[:, None, None], (len(outputs), side, side)).copy()
        for i in range(3):
            for j in range(3):
                sums += np.einsum("oc,chw->ohw", k[:, :, i, j], grid[:, i : i + side, j : j + side])
        own = df.loc[(row >= 1) & (row <= side) & (col >= 1) & (col <= side), [image, "row", "col"]].drop_duplicates()
        at = own["row"].to_numpy() - df["_r"].iloc[0] * side, own["col"].to_numpy() - df["_c"].iloc[0] * side
        found = sums[:, at[0], at[1]]
        return pd.concat([own.reset_index(drop=True), pd.DataFrame((np.maximum(found, 0) if positive else found).T, columns=outputs)], axis=1)

    return held.groupBy(image, "_r", "_c").applyInPandas(one, schema)


def convolved(tiles: DataFrame, kernel: list[list[float]], bias: float, image: str = "image") -> DataFrame:
    """image, row, col, value of one 3x3 convolution of (image, row, col, value). Layers chain; pooled() halves and
    doubled() doubles between them."""
    return layer(tiles, [[kernel]], [bias], ["value"], ["value"], image)


def labelled(tiles: DataFrame, channels: list[str]) -> DataFrame:
    """image, row, col, label: the place of the largest channel of each pixel, the first of equal ones."""
    every = F.array(*channels)
    return tiles.select("image", "row", "col", (F.array_position(every, F.array_max(every)) - 1).cast("int").alias("label"))


def pooled(tiles: DataFrame) -> DataFrame:
    """The largest of each two by two."""
    half = lambda c: F.floor(F.col(c) / 2).cast("bigint")
    return tiles.groupBy("image", half("row").alias("row"), half("col").alias("col")).agg(F.max("value").alias("value"))


def doubled(tiles: DataFrame) -> DataFrame:
    """Each pixel as two by two."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    return tiles.select("image", F.explode(steps).alias("o"), "row", "col", "value").select(
        "image", (F.col("row") * 2 + F.col("o.i")).alias("row"), (F.col("col") * 2 + F.col("o.j")).alias("col"), "value"
    )
