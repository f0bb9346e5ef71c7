"""SimHash near-dedup: exact links between 64-bit fingerprints by tiled exclusive-or and bit counts.

A fingerprint's bit is 1 if it is set in over half the hashes of a text's word shingles. Fingerprints link when
they differ in at most RADIUS bits. Copies have one fingerprint and are compared once.

Two fingerprints that differ in up to RADIUS bits agree in one of RADIUS + 1 lanes of their bits, so only
fingerprints with a lane in common are compared. Those of one lane value are ordered by population count and cut
into tiles; tile pairs whose population counts lie further apart than the radius are skipped, the others are
compared by numpy, all against all. A lane value that many fingerprints share so becomes many tile pairs, dealt
to many tasks. Of a tile pair only the edges of a spanning forest come out: no link between components is lost,
and no group's pairs are written out.

Defined results: a null or empty text, or one of white space, has fingerprint zero and links like any other; a
text of fewer words than a shingle has one shingle, all its words. Rows with equal doc_ids are told apart by
their texts; a null doc_id belongs to its component and names it only if nothing else does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, read
from geoloom.operators.graph import components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints of a tile; a tile pair holds this number squared of bytes while it is compared.
TILE = 1_024
#: Hashes counted at once: memory stays bounded for a text of any length.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    if len(words) < shingle:
        spans = [joined]
    else:
        spans = map(joined.__getitem__, map(slice, [0, *ends[: len(words) - shingle]], [e - 1 for e in ends[shingle - 1 :]]))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    spans = iter(spans)
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(s, SEED) for s, _ in zip(spans, range(min(BLOCK, n - at)), strict=False)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t) for t in batch.column("__text").to_pylist()), np.uint64, batch.num_rows)
        at = batch.schema.get_field_index("__text")
        yield pa.RecordBatch.from_arrays(
            [c if i != at else pa.array(found.view(np.int64)) for i, c in enumerate(batch.columns)],
            names=[n if i != at else "fp" for i, n in enumerate(batch.schema.names)],
        )


def _forest(fps: np.ndarray, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges to the least member of every component of a tile pair's links (indices into fps)."""
    label = np.arange(len(fps))
    while True:
        low = label.copy()
        np.minimum.at(low, first, label[second])
        np.minimum.at(low, second, label[first])
        low = low[low]
        if (low == label).all():
            break
        label = low
    for i in np.flatnonzero(label != np.arange(len(fps))):
        yield int(fps[i]), int(fps[label[i]])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = right.values.to_numpy(zero_copy_only=False).view(np.uint64) if right.is_valid else a
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                both = np.concatenate([a, b]).view(np.int64)
                for u, v in _forest(both, i, j + len(a)) if right.is_valid else _forest(a.view(np.int64), i, j):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def tile_pairs(entries: DataFrame, block: list[str], name: str, radius: int = RADIUS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Tiles of entries (the columns of block, ones, own) that are compared all against all, and pairs of such tiles.

    The first has left, the owns of a block's tile; the second left and right. ones is a fingerprint's population count.
    A block's entries are numbered within their population count only: neither one task nor one sort holds a common
    block's rows together, and the tiles follow from counts. Pairs of tiles whose counts differ by over radius are
    skipped."""
    salted = entries.withColumn("part", F.pmod(F.xxhash64("own"), F.lit(64)).cast("int"))
    sizes = salted.groupBy(*block, "ones", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*block, "ones").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).withColumn(
        "group", F.sum("n").over(W.partitionBy(*block))
    ).filter("group > 1")
    placed = salted.join(sizes, [*block, "ones", "part"])
    nth = F.row_number().over(W.partitionBy(*block, "ones", "part").orderBy("own"))
    # Small groups are one tile; large ones are cut by population count and place.
    cell = F.when(F.col("group") <= tile, F.lit(-1)).otherwise(F.col("ones"))
    seat = F.when(F.col("group") <= tile, F.lit(0)).otherwise(F.floor((F.col("before") + nth - 1) / tile)).cast("bigint")
    tiles = cut(
        placed.withColumn("cell", cell)
        .withColumn("seat", seat)
        .groupBy(*block, "cell", "seat")
        .agg(F.sort_array(F.collect_list("own")).alias("owns")),
        f"{name}-tiles",
    )
    keys = tiles.select(*block, F.col("cell").cast("int").alias("cell"), "seat")
    ahead = keys.filter("cell >= 0").select(
        *block, F.col("cell").alias("cell_a"), F.col("seat").alias("seat_a"),
        F.explode(F.sequence(F.col("cell"), F.col("cell") + radius)).alias("cell_b"),
    )
    pairs = ahead.join(keys.select(*block, F.col("cell").alias("cell_b"), F.col("seat").alias("seat_b")), [*block, "cell_b"])
    pairs = pairs.filter("cell_a < cell_b OR seat_a < seat_b")
    left = tiles.select(*block, F.col("cell").alias("cell_a"), F.col("seat").alias("seat_a"), F.col("owns").alias("left"))
    right = tiles.select(*block, F.col("cell").alias("cell_b"), F.col("seat").alias("seat_b"), F.col("owns").alias("right"))
    across = pairs.join(left, [*block, "cell_a", "seat_a"]).join(right, [*block, "cell_b", "seat_b"])
    return tiles.filter(F.size("owns") > 1).select(F.col("owns").alias("left")), across.select("left", "right")


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of fps (column fp) whose components are those of all links."""
    lanes = radius + 1
    width = -(-64 // lanes)
    lane = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(lanes)]
    entries = fps.select(
        F.col("fp").alias("own"),
        F.bit_count("fp").alias("ones"),
        F.posexplode(F.array(*lane)).alias("lane", "value"),
    )
    within, across = tile_pairs(entries, ["lane", "value"], "simhash", radius, tile)
    work = within.withColumn("right", F.lit(None).cast("array<bigint>")).union(across)
    return work.mapInArrow(_compare(radius), "u bigint, v bigint").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """fp, component_id of (doc_id, fp): the smallest doc_id of all whose fingerprints are reachable."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = cut(least, "simhash-distinct")
    roots = components(links(least.select("fp")))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    prints = docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")
    prints = cut(prints, "simhash-prints")
    return prints.join(classes(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
