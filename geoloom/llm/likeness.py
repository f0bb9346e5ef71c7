"""SimHash near-dedup at a likeness: texts link when the Jaccard index of their sets of five-word shingles is 0.8 or more.

Each distinct set has a SimHash of 256 bits, and BANDS hashes of WIDTH minima each of its shingles' hashes under shared
permutations. Sets that share such a hash are a block: sets at the bound share none with odds of (1 - 0.8 ** 4) ** 40,
under 10^-9, while sets that share a passage alone seldom do, however many have it. A block's fingerprints are compared
in tiles, by exclusive-or and bit counts, and tile pairs whose population counts differ beyond the radius are skipped
(simhash.tile_pairs). What lies within the radius is verified by the whole sets. Sets at the bound differ in a bit with odds
of 0.152, sets of a few shingles with up to 0.19; the radius is five standard deviations above (odds of 10^-6 at the
bound itself, falling fast above it), where sets of a likeness below 0.5 do not come. Those that do and share much, but less
than the bound, are told apart in the tile by sketches: a byte of the least hash in each of BINS bins, whose agreement
is nearly the likeness itself for short sets; a pair stays within five standard deviations of the bound, so that what leaves
a tile are links and few others, not all pairs of a passage's texts.

Copies have one set and are compared once. Two rounds hold each block's sets against a single one of them, which
joins large groups of near copies with as many pairs as members; after them only sets of different components are
compared, and no group's pairs are written out.

Defined results: texts without words have the empty set and are alike; a text of fewer words than a shingle has one,
all its words. Sets are told apart by 64-bit hashes, as shingles are. Rows alike in doc_id and text are one; a null
doc_id stays only if no other of its group has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.simhash import BLOCK, SEED, tile_pairs
from geoloom.llm.tables import NARROW_ROWS, cut, join_small
from geoloom.operators.graph import components

SHINGLE = 5
#: The least likeness, as a fraction.
UP, DOWN = 4, 5
#: Blocks of a set, and minima that a block's hash is made of; words of a fingerprint.
BANDS, WIDTH, WORDS = 40, 4, 4
#: Bits of the 256 in which the fingerprints of a link differ at most, sets of under FEW shingles and others; a tile's size.
FEW, RADIUS_FEW, RADIUS, TILE = 32, 84, 68, 512
#: Shingles whose minima are taken at once; bins of a sketch, a power of two; pairs whose sketches are held together at once.
STEP, BINS, AT_ONCE = 1_024, 1_024, 4_096
_rng = np.random.Generator(np.random.PCG64(20_241_128))
_turns = _rng.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PRINT = tuple(f"f{i}" for i in range(WORDS))
_folds = _rng.integers(0, 1 << 63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = map(joined.__getitem__, map(slice, [0, *ends[: len(words) - shingle]], [e - 1 for e in ends[shingle - 1 :]]))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in spans), np.uint64, len(words) - shingle + 1))


def _again(h: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash."""
    x = h ^ (h >> np.uint64(33))
    with np.errstate(over="ignore"):
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(own: np.ndarray) -> list[int]:
    """WORDS words of 64 bits: a bit is 1 if it is set in over half of a set's hashes."""
    words, h = [], own
    for _ in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), BLOCK):
            ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
        h = _again(h)
    return words


def blocks(own: np.ndarray) -> np.ndarray:
    """The hashes of a set's blocks."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), STEP):
            np.minimum(least, (own[at : at + STEP, None] * _turns).min(axis=0), out=least)
        return _again((least.reshape(BANDS, WIDTH) * _folds[:WIDTH]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _folds[WIDTH])


def sketch(own: np.ndarray) -> bytes:
    """A byte for each of BINS bins of a set's hashes: 1 to 255, a hash of the least in the bin, or 0 where the bin is empty."""
    x = np.sort(_again(own ^ np.uint64(SEED)))
    bins = (x >> np.uint64(65 - BINS.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint8)
    out[bins[first]] = (x[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def sketched(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether rows of sketches may be of sets at the bound, n being the sum of two sets' sizes. Bins in which both agree, of
    those that either fills, are the likeness on average, with the variance of one permutation's bins (Li, Owen, Zhang 2012);
    what stays is within five standard deviations and a bin."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    filled = np.maximum(1, ((a | b) > 0).sum(axis=1))
    others = np.maximum(1.0, n * DOWN / (UP + DOWN) - 1)
    spread = np.maximum(0.0, (1 / filled) * (1 + 1 / others) - 1 / others) * UP * (DOWN - UP) / DOWN**2
    return same + 1 >= filled * (UP / DOWN - 5 * np.sqrt(spread))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, words, found, sketches = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            own = shingles(text)
            keys.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            words.append(fingerprint(own))
            found.append(blocks(own).view(np.int64))
            sketches.append(sketch(own))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                *(pa.array([w[i] for w in words], pa.int64()) for i in range(WORDS)), pa.array(found, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary()),
            ],
            names=["doc_id", "h", "key", "n", *PRINT, "blocks", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        keys = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.tobytes() for x in found], pa.binary())], names=["key", "set"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            same.append(DOWN * both >= UP * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(same, pa.bool_()))


def _verified(pairs: DataFrame, one: DataFrame, texts: DataFrame, repeats: bool, name: str) -> DataFrame:
    """The pairs (u, v) whose sets reach the bound. Only texts that stand in a pair have their sets worked out and moved;
    repeats: whether some row of texts comes more than once."""
    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    rows = cut(one.join(keys, "key", "left_semi").select(*_named(F.col("best.doc_id")), F.col("best.h").alias("h")), f"{name}-rows")
    own = join_small(texts.select(*_named(), "h", "text"), rows, ["own_id", "no_id", "h"], "left_semi", NARROW_ROWS)
    sets = own.select("text").mapInArrow(_sets, "key bigint, set binary")
    sets = cut(sets.groupBy("key").agg(F.first("set").alias("set")) if repeats else sets, f"{name}-sets")
    met = pairs.join(sets.select(F.col("key").alias("u"), F.col("set").alias("set_a")), "u").join(
        sets.select(F.col("key").alias("v"), F.col("set").alias("set_b")), "v"
    )
    return cut(met.select("u", "v", "set_a", "set_b").mapInArrow(_alike, "u bigint, v bigint"), name)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile (left, right null), or of two, that the bound allows: of different components, of sizes near
    enough, within RADIUS bits and of sketches that agree."""
    fields = ("key", "root", "n", *PRINT)

    def columns(list_) -> list[np.ndarray]:
        return [list_.values.field(x).to_numpy(zero_copy_only=False) for x in fields]

    def bins(list_) -> np.ndarray:
        return np.frombuffer(b"".join(list_.values.field("sketch").to_pylist()), np.uint8).reshape(-1, BINS)

    for batch in batches:
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            a = columns(left)
            b = columns(right) if right.is_valid else a
            apart = sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(np.uint16) for x, y in zip(a[3:], b[3:], strict=True))
            less, more = np.minimum(a[2][:, None], b[2][None, :]), np.maximum(a[2][:, None], b[2][None, :])
            near = (apart <= np.where(less < FEW, RADIUS_FEW, RADIUS)) & (DOWN * less >= UP * more)
            i, j = np.nonzero(near & (a[1][:, None] != b[1][None, :]))
            if not right.is_valid:
                i, j = i[i < j], j[i < j]
            if len(i):
                x = bins(left)
                y = bins(right) if right.is_valid else x
                spans = range(0, len(i), AT_ONCE)
                own = [(i[k : k + AT_ONCE], j[k : k + AT_ONCE]) for k in spans]
                stay = np.concatenate([sketched(x[p], y[q], a[2][p].astype(np.int64) + b[2][q]) for p, q in own])
                i, j = i[stay], j[stay]
            us.append(np.minimum(a[0][i], b[0][j]))
            vs.append(np.maximum(a[0][i], b[0][j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _near(a: Column, b: Column) -> Column:
    """Whether two structs' sizes and fingerprints allow the bound."""
    bits = sum((F.bit_count(a[f].bitwiseXOR(b[f])) for f in PRINT), F.lit(0))
    less = F.least(a["n"], b["n"])
    return (DOWN * less >= UP * F.greatest(a["n"], b["n"])) & (bits <= F.when(less < FEW, RADIUS_FEW).otherwise(RADIUS))


def _placed(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """tokens with root, the component of their key; only of blocks that more than one component has."""
    found = tokens.join(components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = found.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    return found.join(several, "token")


def _named(row: Column | str = "doc_id") -> tuple[Column, Column]:
    """doc_id as two columns to join on, null or not."""
    return F.coalesce(row, F.lit(0)).alias("own_id"), F.isnull(row).alias("no_id")


def links(one: DataFrame, texts: DataFrame, sketches: DataFrame, repeats: bool) -> DataFrame:
    """Edges (u, v) of (key, best, n, fingerprint, blocks), one row a set, whose components are those of all pairs at the bound.
    best: the row of texts (doc_id, h, text) that has the set; sketches: key, sketch, of copies as often as they come; repeats:
    whether some row comes more than once."""
    # Blocks move once and are sorted once: a join of them with their own counts would do both twice, and hold tables of counts.
    every = one.select("key", F.explode("blocks").alias("token"))
    shared = every.withColumn("many", F.count("*").over(W.partitionBy("token"))).filter("many > 1").select("token", "key")
    shared = cut(shared, "alike-shared")
    tokens = cut(shared.join(one.select("key", "n", *PRINT), "key"), "alike-tokens")
    member = F.struct("key", "n", *PRINT)
    seen = edges = None
    for turn, pick in enumerate((F.min, F.max)):
        left = tokens if edges is None else cut(_placed(tokens, edges), "alike-placed")
        hub = left.groupBy("token").agg(pick(member).alias("hub"))
        pairs = left.join(hub, "token").filter((F.col("key") != F.col("hub.key")) & _near(member, F.col("hub")))
        pairs = pairs.select(F.least("key", "hub.key").alias("u"), F.greatest("key", "hub.key").alias("v")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["u", "v"], "left_anti")
        pairs = cut(pairs, f"alike-pairs{turn}")
        found = _verified(pairs, one, texts, repeats, f"alike-edges{turn}")
        seen, edges = (pairs, found) if seen is None else (seen.union(pairs), edges.union(found))
    ones = sum((F.bit_count(f) for f in PRINT), F.lit(0)).alias("ones")
    entries = cut(_placed(tokens, edges).select("token", "key", "root", "n", *PRINT), "alike-left")
    # Sketches move only for sets that are left, once a set, and then to their tiles.
    wide = sketches.join(entries.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("sketch").alias("sketch"))
    entries = entries.join(cut(wide, "alike-sketches"), "key")
    entries = entries.select("token", ones, F.struct("key", "root", "n", *PRINT, "sketch").alias("own"))
    within, across = tile_pairs(entries, ["token"], "alike", RADIUS_FEW, TILE)
    # Near copies share many blocks: equal tiles are compared once.
    within = within.distinct().withColumn("right", F.lit(None).cast(within.schema["left"].dataType))
    rest = within.union(across).mapInArrow(_compare, "u bigint, v bigint").distinct()
    rest = cut(rest.join(seen, ["u", "v"], "left_anti"), "alike-pairs")
    return edges.union(_verified(rest, one, texts, repeats, "alike-edges"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (null last, then by hash of its text), with the columns
    of docs. Rows alike in both are one. Components are settled on ids alone; the documents meet one semi-join."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = f"doc_id bigint, h bigint, key bigint, n int, {', '.join(f + ' bigint' for f in PRINT)}, blocks array<bigint>, sketch binary"
    rows = cut(texts.mapInArrow(_prints, schema), "alike-rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    one = rows.groupBy("key").agg(F.min(row).alias("best"), *[F.first(x).alias(x) for x in ("n", *PRINT, "blocks")])
    one = cut(one, "alike-distinct")
    again = cut(rows.groupBy(*_named(), "h").count().filter("count > 1").select("own_id", "no_id", "h"), "alike-again")
    roots = components(links(one, texts, rows.select("key", "sketch"), not again.isEmpty())).withColumnRenamed("node", "key")
    placed = cut(one.join(roots, "key", "left").select("key", "best", F.coalesce("root", "key").alias("root")), "alike-roots")
    kept = placed.groupBy("root").agg(F.min("best").alias("kept")).join(placed, "root").select("key", "kept")
    # What goes is mostly less than what stays, so it is what the documents are held against.
    gone = rows.select("doc_id", "h", "key").join(kept, "key").filter(~row.eqNullSafe(F.col("kept"))).select(*_named(), "h")
    gone = cut(gone.distinct(), "alike-gone")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_named(), F.xxhash64("text").alias("h"))
    name = ["own_id", "no_id", "h"]
    left = join_small(own, gone, name, "left_anti", NARROW_ROWS)
    repeated = join_small(left, again, name, "left_semi", NARROW_ROWS).dropDuplicates(name)
    return join_small(left, again, name, "left_anti", NARROW_ROWS).union(repeated).select("doc.*")
