"""Choosing scenes: cloud bounds, first of each id, order, limits, coverage of an area and the choice of radar.

Tables have the columns of `schema.SCENES`. `ord` is the place of a scene in its list: whatever the order of a list
decides is decided by it. A null cloud cover passes both bounds, stands before all others in order, is left out of
the least, and comes last where one scene is picked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, contains
from geoloom.request import BBox, PullRequest
from geoloom.tables import join_checked

#: Kinds whose cloud cover counts, and kinds that fill no area.
CLOUDY = ("optical", "browse")
FILLS_NOTHING = ("browse", "lidar", "altimetry")
#: Cloud cover up to which a scene is clear, and the share of an area that clear scenes have to cover.
CLEAR_CLOUD, CLEAR_COVERAGE = 20.0, 0.5
GRID = 16
#: Degrees by which the gap across 180 degrees may seem less than another and still be as wide.
TIE = 1e-12


def cloud_within(low: float | None, high: float | None) -> Column:
    """Inclusive bounds; they bind only kinds whose cloud cover counts."""
    fits = F.lit(True)
    if low is not None:
        fits = fits & (F.col("cloud") >= low)
    if high is not None:
        fits = fits & (F.col("cloud") <= high)
    return ~F.col("kind").isin(*CLOUDY) | F.col("cloud").isNull() | fits


def counts_for_coverage() -> Column:
    return (F.col("geometry_kind") != "point") & ~F.col("footprint_is_request") & ~F.col("kind").isin(*FILLS_NOTHING)


def first_of_each(scenes: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the least ord for each key. The least of a struct is aggregated before the shuffle, so no key's rows
    meet in one task; a window would gather and sort them."""
    rest = [c for c in scenes.columns if c not in (*keys, "ord")]
    row = F.min(F.struct("ord", *rest)).alias("row")
    if any(t.startswith(("map", "variant")) for _, t in scenes.dtypes):
        row = F.min_by(F.struct("ord", *rest), "ord").alias("row")
    return scenes.groupBy(*keys).agg(row).select(*[c if c in keys else F.col("row")[c].alias(c) for c in scenes.columns])


def last_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the largest ord for each key."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.max_by(F.struct(*rest), "ord").alias("row")
    return rows.groupBy(*keys).agg(row).select(*[c if c in keys else F.col("row")[c].alias(c) for c in rows.columns])


def clearest_order() -> list[Column]:
    """Least cloud, then newest, then place in the list."""
    cloud = F.when(F.col("kind").isin(*CLOUDY) & F.col("cloud").isNotNull(), F.col("cloud")).otherwise(F.lit(-1.0))
    return [cloud.asc(), F.col("ts").desc(), F.col("ord").asc()]


def picked(scenes: DataFrame, limit: int | None, mode: str | None = "first", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Up to limit scenes of each list (the rows of one key), in order of time: first, last or evenly spread.

    Scenes are ranked in two steps, by day and then within the day, so that a list of any length is never sorted in
    one task: days are few, and their counts are what the running sums need."""
    if limit is None:
        return scenes
    day = scenes.withColumn("_day", F.col("ts").cast("date"))
    counts = day.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.withColumn("_all", F.sum("_n").over(W.partitionBy(*keys))).drop("_n")
    within = W.partitionBy(*keys, "_day").orderBy("ts", "ord")
    ranked = join_checked(day, counts, [*keys, "_day"]).withColumn("_at", F.col("_before") + F.row_number().over(within) - 1)
    n, at = F.col("_all"), F.col("_at")
    if mode == "last":
        keep = at >= n - limit
    elif mode == "even" and limit > 1:
        # The places i * (n - 1) / (limit - 1), halves to even; a place is kept if some i lands on it.
        i = F.floor(at * (limit - 1) / (n - 1))
        near = [F.bround((i + k) * (n - 1) / F.lit(float(limit - 1))) == at for k in (-1, 0, 1)]
        inside = [(i + k >= 0) & (i + k <= limit - 1) for k in (-1, 0, 1)]
        keep = (near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])
    else:
        keep = at < limit
    return ranked.filter((n <= limit) | keep).select(*scenes.columns)


def select(scenes: DataFrame, request: PullRequest, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Scenes within the cloud bounds, the first of each id of a list, capped by the request's limit."""
    kept = scenes.filter(cloud_within(request.min_cloud, request.max_cloud))
    return picked(first_of_each(kept, [*keys, "id"]), request.limit, request.limit_mode, keys)


def ranked(scenes: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """scenes with rank: their place in the list, clearest first.

    In two steps, by whole percent of cloud and day, and then within these, so that a list of any length is never sorted
    in one task: what the running sums need is one count each."""
    cloud = F.floor(F.when(F.col("kind").isin(*CLOUDY) & F.col("cloud").isNotNull(), F.col("cloud")).otherwise(F.lit(-1.0)))
    own = scenes.withColumn("_cloud", cloud).withColumn("_day", F.col("ts").cast("date"))
    cell = [*keys, "_cloud", "_day"]
    counts = own.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy(F.col("_cloud"), F.col("_day").desc()).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(W.partitionBy(*cell).orderBy(*clearest_order()))
    return join_checked(own, counts, cell).withColumn("rank", (F.col("_before") + nth).cast("int")).select(*scenes.columns, "rank")


def lattice(area: BBox, grid: int = GRID) -> list[tuple[int, float, float]]:
    """The middles of the cells of a grid over an area: (number, lon, lat)."""
    found = []
    for i in range(grid):
        lon = area.west + area.span * (i + 0.5) / grid
        lon -= 360 if lon > 180 else 0
        found += [(i * grid + j, lon, area.south + (area.north - area.south) * (j + 0.5) / grid) for j in range(grid)]
    return found


def coverage(scenes: DataFrame, area: BBox, keys: tuple[str, ...] = ("source",), grid: int = GRID) -> DataFrame:
    """keys and coverage: the share of a lattice over the area that lies in some counted scene of the list.

    Each scene is turned into the bits of the lattice points it holds, four words of 64; the bits of a list are
    or-ed before the shuffle. Nothing multiplies rows, and a list is one row of four numbers."""
    points, width = lattice(area, grid), 64
    lons = [points[i * grid][1] for i in range(grid)]
    lats = [points[j][2] for j in range(grid)]
    b = Box.col()
    # The runs of columns and rows that a box holds, as bits; a word is 64 / grid columns of grid rows.
    row_bits = F.lit(0).cast("bigint")
    for j, lat in enumerate(lats):
        row_bits = row_bits + F.when((b.south <= lat) & (b.north >= lat), F.lit(1 << j)).otherwise(F.lit(0))
    per = width // grid
    words = []
    for k in range(grid // per):
        word = F.lit(0).cast("bigint")
        for m in range(per):
            inside = contains(Box(b.west, F.lit(0.0), b.east, F.lit(0.0)), F.lit(lons[k * per + m]), F.lit(0.0))
            word = word.bitwiseOR(F.when(inside, F.shiftleft("_rows", m * grid)).otherwise(F.lit(0).cast("bigint")))
        words.append(word.alias(f"_w{k}"))
    held = scenes.filter(counts_for_coverage()).withColumn("_rows", row_bits.cast("bigint")).select(*keys, *words)
    bits = held.groupBy(*keys).agg(*[F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(grid // per)])
    hits = sum((F.bit_count(f"_w{k}") for k in range(grid // per)), F.lit(0))
    covered = bits.select(*keys, (hits / F.lit(float(grid * grid))).alias("coverage"))
    if not keys:
        return covered.select(F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    every = scenes.select(*keys).distinct()
    return every.join(covered, list(keys), "left").select(*keys, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def consolidated(scenes: DataFrame, request: PullRequest) -> DataFrame:
    """One row a source that has scenes left: n_scenes, cloud and coverage. Its scenes, in order, are the rows of
    ranked(select(...)): a list of any length is rows, not one cell."""
    chosen = select(scenes, request)
    low = F.min(F.when(F.col("kind").isin(*CLOUDY), F.col("cloud")))
    summed = chosen.groupBy("source").agg(F.count("*").alias("n_scenes"), low.alias("cloud"))
    return summed.join(coverage(chosen, request.bbox), "source")


def consolidated_scenes(scenes: DataFrame, request: PullRequest) -> DataFrame:
    """source, rank, id of the scenes that a request leaves, clearest first, beside what is said of their source."""
    chosen = ranked(select(scenes, request)).select("source", "rank", "id")
    return join_checked(chosen, consolidated(scenes, request), ["source"])


def representative_cloud(scenes: DataFrame, keys: tuple[str, ...] = ("source", "collection")) -> DataFrame:
    """The least cloud among scenes of kinds that have any; null if none is known."""
    return scenes.groupBy(*keys).agg(F.min(F.when(F.col("kind").isin(*CLOUDY), F.col("cloud"))).alias("cloud"))


@dataclass(frozen=True)
class Radar:
    threshold: float = CLEAR_COVERAGE
    clear_cloud: float = CLEAR_CLOUD


def analysis_input(scenes: DataFrame, request: PullRequest, rule: Radar = Radar()) -> DataFrame:
    """One row: n_optical, n_sar, clear (share of the area under clear optical scenes), analysis_input and note.

    Radar stands in for optical scenes if too little of the area is clear, clouds weren't asked for, and there is any."""
    most = request.max_cloud if request.max_cloud is not None else rule.clear_cloud
    optical = scenes.filter(F.col("kind") == "optical")
    clear = coverage(optical.filter(cloud_within(None, most)), request.bbox, keys=())
    counts = scenes.agg(
        F.count_if(F.col("kind") == "optical").alias("n_optical"),
        F.count_if(F.col("kind") == "sar").alias("n_sar"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "sar", F.col("source")))).alias("sar_sources"),
    )
    # Two rows of totals, side by side.
    both = counts.crossJoin(clear)
    short = (F.lit(request.min_cloud is None)) & (F.col("coverage") < rule.threshold) & (F.col("n_sar") > 0)
    share = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    names = F.array_join("sar_sources", ", ")
    low = F.concat(
        F.lit("optical skipped for cloud: "), share(F.col("coverage")), F.lit(f" of the AOI has optical at or under {most:g}% cloud, below the "),
        share(F.lit(rule.threshold)), F.lit(" threshold; using SAR from "), names,
    )
    none = F.concat(F.lit("optical unavailable: no optical scenes returned (0% clear coverage); using SAR from "), names)
    return both.select(
        "n_optical",
        "n_sar",
        F.col("coverage").alias("clear"),
        F.when(short, F.lit("sar")).when(F.col("n_optical") > 0, F.lit("optical")).alias("analysis_input"),
        F.when(short & (F.col("n_optical") > 0), low).when(short, none).alias("note"),
    )


def mosaic_sample(scenes: DataFrame) -> DataFrame:
    """The scene of each source that stands for it in a mosaic: of least cloud, unknown last."""
    key = F.struct(F.coalesce("cloud", F.lit(float("inf"))).alias("cloud"), "ord")
    return scenes.groupBy("source").agg(F.min_by(F.struct("id", "cloud"), key).alias("s")).select("source", "s.id", "s.cloud")


def newest(scenes: DataFrame, n: int) -> DataFrame:
    """The n newest, in order of time."""
    return scenes.orderBy(F.col("ts").desc(), F.col("ord")).limit(n).orderBy("ts", "ord")


def enclosing_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the least box around the points (lon, lat) of each: the circle without its widest gap. The gap across 180
    degrees wins a tie (to within TIE degrees, as gaps are rounded), then the one that lies furthest west.

    Gaps are found in two steps, within a degree and between the degrees that have points, so no key's points are gathered
    or sorted in one task; a key has 361 degrees at most."""
    gap = lambda over: F.struct((F.col("a") - over).alias("gap"), (-F.col("a")).alias("west"), over.alias("east"))
    own = points.groupBy(*keys, F.floor("lon").alias("cell"), F.col("lon").alias("a")).agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    before = F.lag("a").over(W.partitionBy(*keys, "cell").orderBy("a"))
    cells = own.withColumn("before", before).groupBy(*keys, "cell").agg(
        F.min("a").alias("a"), F.max("a").alias("b"), F.min("south").alias("south"), F.max("north").alias("north"),
        F.max(F.when(F.col("before").isNotNull(), gap(F.col("before")))).alias("inner"),
    )
    last = F.lag("b").over(W.partitionBy(*keys).orderBy("cell"))
    widest = F.greatest(F.col("inner"), F.when(F.col("last").isNotNull(), gap(F.col("last"))))
    found = cells.withColumn("last", last).groupBy(*keys).agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.min("south").alias("south"), F.max("north").alias("north"), F.max(widest).alias("w")
    )
    inside = F.coalesce(F.col("w.gap") > 360.0 - (F.col("b") - F.col("a")) + TIE, F.lit(False))
    return found.select(
        *keys, F.when(inside, -F.col("w.west")).otherwise(F.col("a")).alias("west"), "south", F.when(inside, F.col("w.east")).otherwise(F.col("b")).alias("east"), "north"
    )
