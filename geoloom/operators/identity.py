"""Stored scenes whose id the catalog no longer knows, matched to what it has now by time, tile and footprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, centre, iou, lon_span
from geoloom.functions.times import bucket, within_seconds
from geoloom.operators.graph import components
from geoloom.tables import cut

TOLERANCE, IOU, SLACK = 60, 0.8, 1e-9
BASELINE_WIDTH = 4


def grid_key(mgrs: Column, code: Column, path: Column, row: Column, orbit: Column) -> Column:
    """The first family that is there, as `name=value` text; null if none is."""
    word = lambda c: F.nullif(F.trim(c), F.lit(""))
    whole = lambda c: F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).cast("bigint").cast("string"))
    return F.coalesce(
        F.concat(F.lit("s2:mgrs_tile="), word(mgrs)),
        F.concat(F.lit("grid:code="), word(code)),
        F.concat(F.lit("landsat:wrs_path="), whole(path), F.lit(";landsat:wrs_row="), whole(row)),
        F.concat(F.lit("sat:relative_orbit="), whole(orbit)),
    )


def baseline_key(text: Column, width: int = BASELINE_WIDTH) -> Column:
    """`05.11` as [5, 11, 0, 0]; null for anything but whole numbers between dots."""
    numbers = F.transform(F.split(F.trim(text), r"\."), lambda x: x.try_cast("int"))
    padded = F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(width - F.size(numbers), F.lit(0))))
    return F.when(F.trim(text).rlike(r"^\d+(\.\d+)*$"), padded)


def footprints_match(a: Box, b: Box) -> Column:
    return iou(a, b) + SLACK >= IOU


def _level(span: Column) -> Column:
    """The finest level whose cells, 360 / 2 ** level degrees wide, are no narrower than span."""
    return F.greatest(F.lit(0), F.least(F.lit(40), F.floor(F.log2(F.lit(360.0) / span)))).cast("int")


def _cell(level: Column, at: Column) -> Column:
    """The cell of a number of degrees from the first edge; beyond a whole turn they come round."""
    turn = F.pow(F.lit(2.0), level)
    return F.pmod(F.floor(at * turn / 360.0), turn.cast("bigint"))


def _own(span: Column, at: Column) -> Column:
    return F.struct(_level(span).alias("level"), _cell(_level(span), at).alias("cell"))


def _reached(span: Column, at: Column) -> Column:
    """The (level, cell) in which the middle of any footprint that matches one of this span and middle lies.

    Where two boxes have IOU or more in common, so have their sides: each is at least IOU times the other, and their
    middles lie within 1 - IOU of the longer one. Boxes over half the globe wide all share the one cell of level 0."""
    least = IOU - 1e-6
    longest, away = span / least, span * (1 - least) / least
    levels = F.sequence(_level(longest), _level(span * least))

    def of(k: Column) -> Column:
        side = F.lit(360.0) / F.pow(F.lit(2.0), k)
        steps = F.sequence(F.floor((at - away) / side), F.floor((at + away) / side))
        return F.transform(steps, lambda n: F.struct(k.alias("level"), F.pmod(n, F.pow(F.lit(2.0), k).cast("bigint")).alias("cell")))

    return F.array_distinct(F.flatten(F.transform(levels, of)))


def matches(stored: DataFrame, candidates: DataFrame, seconds: int = TOLERANCE) -> DataFrame:
    """old_id, old_ord and the columns of each candidate that may stand for a stored scene.

    Both: id, collection, ts, edges, grid_key; stored also ord. An equal join on the collection, a bucket of time and the
    cells of the footprint's middle and sizes: a candidate has one key, a stored scene those that a match can have. Then
    the exact tests. A stored scene without a grid key takes any; boxes without an area match nothing."""
    b, sized = Box.col(), (lon_span(Box.col()) > 0) & (F.col("north") > F.col("south"))
    lon, lat = centre(b)
    axes = ((lon_span(b), lon + 180.0), (b.north - b.south, lat + 90.0))
    old = stored.filter(sized).select(
        F.col("id").alias("old_id"), F.col("ord").alias("old_ord"), "collection", F.col("ts").alias("old_ts"), F.col("grid_key").alias("old_key"), b.struct().alias("old_box"),
        F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: bucket(F.col("ts"), seconds) + k).alias("_buckets"), *[_reached(*a).alias(k) for k, a in zip(("_xs", "_ys"), axes, strict=True)],
    )
    old = old.withColumn("_bucket", F.explode("_buckets")).withColumn("_x", F.explode("_xs")).withColumn("_y", F.explode("_ys")).drop("_buckets", "_xs", "_ys")
    new = candidates.filter(sized).withColumns({"_bucket": bucket(F.col("ts"), seconds), "_x": _own(*axes[0]), "_y": _own(*axes[1])})
    met = old.join(new.hint("merge"), ["collection", "_bucket", "_x", "_y"])
    fits = within_seconds(F.col("old_ts"), F.col("ts"), seconds) & (F.col("old_key").isNull() | F.col("old_key").eqNullSafe(F.col("grid_key"))) & (F.col("old_id") != F.col("id"))
    return met.filter(fits & footprints_match(Box.col("old_box"), b)).drop("_bucket", "_x", "_y", "old_box", "old_key")


def chosen(found: DataFrame, seconds: int = TOLERANCE) -> DataFrame:
    """old_id, n, new_id: the one match, or the newest baseline among matches that are one scene; else null.

    Matches are one scene if their grid keys are equal, all times lie within the tolerance, and all footprints agree
    with one another. The extremes of a stored scene's few candidates decide the first two; footprints are compared
    pair by pair, each different one once: new versions of a scene mostly have the same."""
    rank = F.struct(
        F.col("baseline").isNotNull().alias("has"), F.coalesce(baseline_key(F.col("baseline")), F.array().cast("array<int>")).alias("b"), F.unix_micros(F.col("stamp").cast("timestamp")).alias("t")
    )
    row = F.struct(rank.alias("rank"), "id", "ts", "grid_key", F.struct("west", "south", "east", "north").alias("box"))
    g = found.groupBy("old_id", "old_ord").agg(F.collect_list(row).alias("m"), F.count("*").alias("n"))
    one_key = F.size(F.array_distinct(F.transform("m", lambda x: x["grid_key"]))) == 1
    times = F.transform("m", lambda x: F.unix_micros(x["ts"].cast("timestamp")))
    close = F.array_max(times) - F.array_min(times) <= seconds * 1_000_000
    box = lambda x: Box(x["west"], x["south"], x["east"], x["north"])
    boxes = F.array_distinct(F.transform("m", lambda x: x["box"]))
    agree = F.forall(boxes, lambda x: F.forall(boxes, lambda y: footprints_match(box(x), box(y))))
    top = F.array_max(F.transform("m", lambda x: x["rank"]))
    best = F.filter("m", lambda x: x["rank"] == top)
    new_id = F.when(F.col("n") == 1, F.col("m")[0]["id"]).when(one_key & close & agree & (F.size(best) == 1), best[0]["id"])
    return g.select("old_id", "old_ord", "n", new_id.alias("new_id"))


def _runs(west: float, east: float) -> list[tuple[float, float]]:
    return [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]


def _alike(a: tuple, b: tuple) -> bool:
    """footprints_match for two boxes that have areas."""
    height = min(a[3], b[3]) - max(a[1], b[1])
    both = height * sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in _runs(a[0], a[2]) for q in _runs(b[0], b[2]))
    size = lambda e: sum(east - west for west, east in _runs(e[0], e[2])) * (e[3] - e[1])
    return height > 0 and both > 0 and both / (size(a) + size(b) - both) + SLACK >= IOU


def _one_scene(left: list[dict], seconds: int) -> bool:
    times, boxes = [r["t"] for r in left], list({tuple(r[k] for k in Box._fields) for r in left})
    return len({r["grid_key"] for r in left}) == 1 and max(times) - min(times) <= seconds * 1_000_000 and all(_alike(a, b) for i, a in enumerate(boxes) for b in boxes[:i])


def _choice(left: list[dict], seconds: int) -> str | None:
    """The one candidate, or the newest of one scene, if there is one newest."""
    if len(left) == 1:
        return left[0]["id"]
    rank = lambda r: (r["baseline"] is not None, r["version"] or [], r["stamp"] is not None, r["stamp"] or 0)
    top = max(map(rank, left))
    best = [r["id"] for r in left if rank(r) == top]
    return best[0] if len(best) == 1 and _one_scene(left, seconds) else None


_FOLDED = pa.schema([("root", pa.string()), ("old_id", pa.string()), ("outcome", pa.string()), ("new_id", pa.string())])


def _folded(seconds: int):
    """Claims, root by root (a component or block) and in order of ord, as rows stream by; what a root has claimed is held, no more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                yield from batch.slice(low, 1000).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        gone: set[str] = set()
        root = None
        for (at, old_id), own in groupby(rows(batches), key=lambda r: (r["root"], r["old_id"])):
            if at != root:
                root, gone = at, set()
            left = list({r["id"]: r for r in reversed(list(own)) if r["id"] not in gone}.values())
            new_id = _choice(left, seconds) if left else None
            gone.add(new_id)
            out.append((root, old_id, "replaced" if new_id else "ambiguous" if left else "no match", new_id))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=_FOLDED)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=_FOLDED)

    return run


#: Seconds of a block of stored scenes that claim in one pass, and rounds after which blocks give way to components.
BLOCK, ROUNDS = 3600, 8


def _by_components(rows: DataFrame, seconds: int) -> DataFrame:
    """Claims by components of stored scenes that share candidates, each in one pass: rounds grow with the logarithm of a
    component's width, not with its chains' length; a task holds the ids claimed in its component."""
    first = rows.groupBy("id").agg(F.min("old_id").alias("v"), F.count("*").alias("_n")).filter("_n > 1")
    links = rows.join(first.hint("merge"), "id").filter("old_id <> v").select(F.col("old_id").alias("u"), "v")
    roots = components(links).select(F.col("node").alias("old_id"), "root")
    return _passed(rows.join(roots.hint("merge"), "old_id", "left").withColumn("root", F.coalesce("root", "old_id")), seconds)


def _passed(rows: DataFrame, seconds: int) -> DataFrame:
    ordered = rows.select("root", *[c for c in rows.columns if c not in ("root", "block")]).repartition("root").sortWithinPartitions("root", "old_ord", "old_id", "ord", "id")
    return ordered.mapInArrow(_folded(seconds), "root string, old_id string, outcome string, new_id string")


def _by_blocks(rows: DataFrame, seconds: int, rounds: int) -> DataFrame | None:
    """Claims by blocks of time, each in one pass and all at once; None if they have not settled.

    At first each block claims as if it were alone. Then what an earlier scene of another block has claimed is taken from a
    scene's candidates, and the blocks for which that has changed claim again, until nothing changes. What has settled is
    the one answer: the first scene's claim hangs on nothing, and each one's on those before it alone."""
    blocks = rows.withColumn("root", F.col("block").cast("string"))
    among = rows.groupBy("id").agg((F.min("block") < F.max("block")).alias("_among")).filter("_among").select("id")
    shared = cut(rows.select("id", "block", "old_ord", "old_id").join(among.hint("merge"), "id"), "shared")
    told, taken = cut(_passed(blocks, seconds), "claims"), None
    for _ in range(rounds):
        claims = shared.join(told.select("old_id", F.col("new_id").alias("id")).hint("merge"), ["old_id", "id"])
        claims = claims.select("id", *[F.col(c).alias(f"_{c}") for c in ("block", "old_ord", "old_id")])
        before = F.struct("_old_ord", "_old_id") < F.struct("old_ord", "old_id")
        now = cut(shared.join(claims.hint("merge"), "id").filter((F.col("_block") != F.col("block")) & before).select("block", "old_id", "id").distinct(), "taken")
        changed = now if taken is None else now.exceptAll(taken).union(taken.exceptAll(now))
        again = cut(changed.select(F.col("block").cast("string").alias("root")).distinct(), "blocks")
        if again.isEmpty():
            return told
        taken = now
        open_rows = blocks.join(again.hint("merge"), "root", "left_semi").join(taken.hint("merge"), ["old_id", "id"], "left_anti")
        told = cut(told.join(again.hint("merge"), "root", "left_anti").unionByName(_passed(open_rows, seconds)), "claims")
    return None


def claimed(stored: DataFrame, found: DataFrame, seconds: int = TOLERANCE, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """old_id, outcome (replaced, ambiguous or no match), new_id of every stored scene. Stored scenes claim in order of
    ord, and an id that one has claimed is no candidate of those behind it.

    Claims are worked out by blocks of time, so that a chain of any length is many tasks; where they do not settle in
    so many rounds, by components. Both are exact."""
    rows = found.select(
        F.floor(F.unix_seconds(F.col("old_ts").cast("timestamp")) / block).alias("block"), "old_id", "old_ord", "id", "ord", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), *Box._fields, "grid_key",
        "baseline", baseline_key(F.col("baseline")).alias("version"), F.unix_micros(F.col("stamp").cast("timestamp")).alias("stamp"),
    )
    rows = cut(rows, "matches")
    told = _by_blocks(rows, seconds, rounds)
    if told is None:
        told = _by_components(rows, seconds)
    return stored.select(F.col("id").alias("old_id")).join(told.drop("root").hint("merge"), "old_id", "left").select(
        "old_id", F.coalesce("outcome", F.lit("no match")).alias("outcome"), "new_id"
    )


def projected(stored: DataFrame, replaced: DataFrame, current: DataFrame) -> DataFrame:
    """id, tier, ord of the rows to write: stored ones with new ids put in place, then the current ones, each id once.

    stored: id, ord. replaced: old_id, new_id. current: id, ord."""
    old = stored.join(replaced.select(F.col("old_id").alias("id"), "new_id"), "id", "left")
    old = old.select(F.coalesce("new_id", "id").alias("id"), F.lit(0).alias("tier"), "ord")
    both = old.unionByName(current.select("id", F.lit(1).alias("tier"), "ord"))
    first = both.groupBy("id").agg(F.min(F.struct("tier", "ord")).alias("at"))
    return first.select("id", "at.tier", "at.ord")


def confirmed(stored: DataFrame, present: DataFrame) -> DataFrame:
    """id and status of stored scenes: confirmed if the catalog still has the id, else missing."""
    there = present.select("id").distinct().withColumn("_there", F.lit(True))
    return stored.select("id").join(there, "id", "left").select("id", F.when(F.col("_there"), "confirmed").otherwise("missing").alias("status"))


