"""Document fingerprints by randomised edit embedding: shared random walks over characters, sampled, banded, verified.

A text is walked by a pointer that stays or moves on at each step, as a random function shared by all texts says of
the step and the character under it. Two texts a few edits apart fall into step again soon after each edit, so what
their pointers show at equal steps differs at few of them: edit distance becomes Hamming distance.

The fingerprint samples those steps. Each step has a level by a shared hash; a text keeps the steps of at least
the lowest level that leaves it no more than SAMPLES in expectation, so texts of like length keep the same steps,
and of unlike length the shorter one's can be thinned to the longer one's. It reads `LL:` (the level, two digits)
and a hex digit, a hash of the character seen, for each step kept.

Near copies are found by banding: groups of WIDTH digits of a fingerprint are sampled over two thirds of its steps or more, and
fingerprints that share a band are verified by their likeness (Hamming, freed of chance). Bands are tied to steps of the level
above the fingerprint's, near its lower bound to those of its own too, and to two of the tiers of its length, so texts either
side of a bound still meet. A band that many share is many tiles, compared all against all; of a tile pair only the edges of a spanning
forest come out, so no group's pairs are written out and none is capped. The bound is on likeness of fingerprints: two
texts at it are missed by all bands about once in 500 to 1,000 times if they have two tiers in common (150 at 19 digits), once in
22 to 40 if one (12 at 19 digits).

Defined results: a null text is an empty one; two empty texts are alike (1.0), an empty and another are not (0.0).
The next document is by descending doc_id, rows of one doc_id by the hash of their text, null last; the last is
followed by the first, and a lone document by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.simhash import _forest, tile_pairs
from geoloom.llm.tables import cut, read
from geoloom.operators.graph import components

#: The shared randomness repeats after PERIOD steps; a pointer rests at most REST steps on a character.
PERIOD, CLASSES, REST = 4_096, 64, 8
#: Characters walked at once; SPAN * REST == PERIOD, so a walk from within one period stays within two.
SPAN = PERIOD // REST
SAMPLES = 256
#: The least likeness of near copies; fingerprints of a tile; digits of two fingerprints at that likeness are at most so many
#: times as many in the one as in the other: LIKE = (1 - 1/16) / (RATIO - 1/16).
LIKE, TILE = 0.8, 512
RATIO = 15 / 16 / LIKE + 1 / 16
#: Numbers of digits that bands are drawn from, each RATIO times the one before: a fingerprint uses the largest two it has.
TIERS = tuple(int(16 * RATIO**i) for i in range(14))
#: Digits of a band, from fewer than FEW and from more, and bands of a tier. Texts that have nothing in common agree in about an
#: eighth of their digits, so in one of 2 ** 30 bands of ten.
FEW, NARROW, WIDTH, BANDS = 40, 8, 10, 28

_rng = np.random.Generator(np.random.PCG64(20_240_607))
_move = _rng.random((CLASSES, PERIOD)) < 0.5


def _steps() -> list[list[int]]:
    """after[c][j]: the step after the one at which a pointer that comes to character class c at step j moves on."""
    ints = list(range(2 * PERIOD + REST + 1))
    table = []
    for c in range(CLASSES):
        twice = np.concatenate([_move[c], _move[c], _move[c][:REST]])
        nxt, row = np.full(len(twice) + 1, len(twice) + REST), []
        for j in range(len(twice) - 1, -1, -1):
            nxt[j] = j if twice[j] else nxt[j + 1]
        for j in range(2 * PERIOD):
            row.append(ints[min(int(nxt[j]), j + REST - 1) + 1])
        table.append(row)
    return table


_after: list[list[int]] | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walk(points: np.ndarray, start: int = 0) -> np.ndarray:
    """ends: ends[i] is the first step at which the pointer has left character i; it began at step start."""
    global _after
    if _after is None:
        _after = _steps()
    after = _after
    kinds = (_mix(points) >> np.uint64(58)).astype(np.uint8).tobytes()
    ends = np.empty(len(points), np.int64)
    base, j = start - start % PERIOD, start % PERIOD
    for at in range(0, len(kinds), SPAN):
        part = [j := after[c][j] for c in kinds[at : at + SPAN]]
        ends[at : at + len(part)] = part
        ends[at : at + len(part)] += base
        base += j - j % PERIOD
        j %= PERIOD
    return ends


def level_of(n_steps: int, samples: int = SAMPLES) -> int:
    """The lowest level that keeps no more than samples of n_steps in expectation."""
    return max(0, int(np.ceil(np.log2(max(1, n_steps) / samples))))


_kept: dict[int, np.ndarray] = {}


def _sampled(level: int, n_steps: int) -> np.ndarray:
    """The steps below n_steps of at least that level: those whose hash has so many zero bits at its end."""
    have = _kept.get(level)
    if have is None or have[-1] < n_steps:
        most = 1 << int(np.ceil(np.log2(max(n_steps, SAMPLES << level) + 1)))
        found = [
            (s := np.arange(at, min(at + (1 << 20), most), dtype=np.uint64))[
                (_mix(s + np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << level) - 1)) == 0
            ]
            for at in range(0, most, 1 << 20)
        ]
        have = np.concatenate([*found, np.array([most], np.uint64)]).astype(np.int64)
        _kept[level] = have
    return have[: np.searchsorted(have, n_steps)]


def sample(points: np.ndarray, ends: np.ndarray) -> str:
    """The fingerprint of a text whose walk is known."""
    n_steps = int(ends[-1]) if len(ends) else 0
    level = level_of(n_steps)
    steps = _sampled(level, n_steps)
    seen = points[np.searchsorted(ends, steps, side="right")] if n_steps else points
    digits = _mix((seen.astype(np.uint64) << np.uint64(32)) + steps.astype(np.uint64)) >> np.uint64(60)
    return f"{level:02d}:" + np.array(list("0123456789abcdef"), "U1")[digits.astype(np.int64)].tobytes().decode("utf-32-le")


def fingerprint(text: str) -> str:
    points = _points(text)
    return sample(points, walk(points))


_stays: dict[tuple[int, int], np.ndarray] = {}


def _thinned(print_: str, level: int) -> np.ndarray:
    """The digits of a fingerprint at a level no lower than its own."""
    own, digits = int(print_[:2]), np.frombuffer(print_[3:].encode(), np.uint8)
    if own == level or not len(digits):
        return digits
    stay = _stays.get((own, level))
    if stay is None or len(stay) < len(digits):
        reach = SAMPLES << own
        steps = _sampled(own, 4 * reach + PERIOD)
        while len(steps) < len(digits):
            reach *= 2
            steps = _sampled(own, 4 * reach)
        steps = steps[: max(len(digits), 2 * SAMPLES)].astype(np.uint64)
        stay = (_mix(steps + np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << level) - 1)) == 0
        _stays[own, level] = stay
    return digits[stay[: len(digits)]]


def likeness(a: str, b: str) -> float:
    """Share of the steps either keeps at which both saw the same, freed of the sixteenth that agrees by chance."""
    if a == b:
        return 1.0
    level = max(int(a[:2]), int(b[:2]))
    x, y = _thinned(a, level), _thinned(b, level)
    both, most = min(len(x), len(y)), max(len(x), len(y))
    if not both:
        return 0.0
    same = int((x[:both] == y[:both]).sum())
    return max(0.0, (same - both / 16) / (most - both / 16))


_drawn = {n: np.array([_rng.permutation(n)[: NARROW if n < FEW else WIDTH] for _ in range(BANDS)]) for n in TIERS}
_VALUES = np.zeros(128, np.int64)
_VALUES[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
_PLACES = np.int64(1) << np.arange(0, 4 * WIDTH, 4, dtype=np.int64)


def bands(print_: str) -> list[int]:
    """One number for each group of sampled digits: the digits, and the level, tier and place that they are drawn at; texts
    that share one are candidates. A fingerprint too short for any tier is one band.

    Digits are those of the level above a fingerprint's own. Those of its own are taken as well where the text may be alike to
    one of the level below (its digits are at most RATIO times as many as such a text can have), and alone where that is a text
    of few steps, all of which level 0 has."""
    own = int(print_[:2])
    digits = _thinned(print_, own)
    half = len(_sampled(own, SAMPLES << own >> 1))
    levels = ([own] if len(digits) <= RATIO * half else []) + ([own + 1] if own or len(digits) > half else [])
    found = []
    for level in levels:
        seen = _VALUES[_thinned(print_, level)]
        tiers = [i for i, n in enumerate(TIERS) if n <= len(seen)][-2:]
        for i in tiers:
            at = _drawn[TIERS[i]]
            tag = ((np.int64(level) << np.int64(4)) + i << np.int64(5)) + np.arange(BANDS)
            found.append((tag << np.int64(4 * WIDTH)) + (seen[at] * _PLACES[: at.shape[1]]).sum(axis=1))
    if not found:
        return [int.from_bytes(hashlib.blake2b(print_.encode(), digest_size=8).digest(), "little", signed=True)]
    return np.concatenate(found).tolist()


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as many characters from the start of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each with the one behind it; the range's last row is the next one's first, and
    only closes it."""
    held, unpack = None, zstandard.ZstdDecompressor().decompress
    rows: list[tuple] = []

    def close(row, following_text, following_print):
        doc_id, text, own, points, ends = row
        keep = len(text) - len(text) // 2
        other = edited(text, following_text)
        tail = _points(other[keep:])
        rest = walk(tail, int(ends[keep - 1]) if keep else 0)
        print_ = sample(np.concatenate([points[:keep], tail]), np.concatenate([ends[:keep], rest]))
        rows.append(
            (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own, print_,
             likeness(own, print_), likeness(own, following_print))
        )

    def out():
        table = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(table, names=_NAMES)

    for batch in batches:
        ids, texts, part = (batch.column(i) for i in range(3))
        for k in range(batch.num_rows):
            text = unpack(texts[k].as_buffer()).decode("utf-8", "surrogatepass")
            points = _points(text)
            ends = walk(points)
            own = sample(points, ends)
            here = part[k].as_py()
            if held is not None and held[0] == here:
                close(held[1], text, own)
            held = (here, (ids[k].as_py(), text, own, points, ends))
            if len(rows) >= 256:
                yield out()
    if rows:
        yield out()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their texts compressed: they move once, whole."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(x.as_buffer()) for x in batch.column(1).cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], names=batch.schema.names)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text (compressed), part: docs dealt to ranges of descending doc_id, and to each range, as its last row, the first
    of the one that follows it. Each text moves once, besides one text a range.

    The bounds are quantiles of doc_id, one number a range, and each range is a partition. Rows of one doc_id, and those
    of none, are neighbours, so they share a range."""
    spark = docs.sparkSession
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", shares, 0.2 / ranges) if shares else []
    # Range 0 has the largest ids; a null id lies in the last range.
    cuts = sorted({int(b) for b in bounds}, reverse=True)
    last = len(cuts)
    if cuts:
        place = F.coalesce(
            F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("doc_id"))), F.lit(last)
        )
        place = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(place)
    else:
        place = F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", place.cast("int"))
    keys = rows.withColumn("tie", F.xxhash64("text"))
    first = keys.groupBy("part").agg(
        F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("d"), (-F.col("tie")).alias("t"))).alias("m")
    )
    first = first.select("part", F.col("m.d").alias("head_id"), (-F.col("m.t")).alias("head_tie"))
    # The heads, one row a range, follow the range before them; the first follows the last.
    order = W.orderBy("part")
    heads = first.withColumn("to", F.coalesce(F.lag("part").over(order), F.max("part").over(W.partitionBy())))
    heads = cut(heads, "edit-heads")
    rows = keys.select("doc_id", "text", "part", "tie")
    closing = (
        rows.join(
            F.broadcast(heads.select("part", "head_id", "head_tie", "to")),
            (rows["part"] == heads["part"]) & rows["doc_id"].eqNullSafe(heads["head_id"]) & (rows["tie"] == heads["head_tie"]),
        )
        .select(rows["doc_id"], rows["text"], F.col("to").alias("part"), rows["tie"])
        .dropDuplicates(["part"])
        .withColumn("closing", F.lit(True))
    )
    every = rows.withColumn("closing", F.lit(False)).unionByName(closing).select("doc_id", "text", "part", "tie", "closing")
    packed = every.mapInArrow(_packed, "doc_id bigint, text binary, part int, tie bigint, closing boolean")
    return (
        packed.repartitionById(last + 1, "part")
        .sortWithinPartitions("part", "closing", F.col("doc_id").desc_nulls_last(), "tie")
        .select("doc_id", "text", "part")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fingerprint string")


def near_next(docs: DataFrame) -> DataFrame:
    """SCHEMA of every row of docs: its fingerprint against its edited text's and the next document's."""
    return with_next(docs).mapInArrow(_chain, SCHEMA)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_pylist()
        found = [list(dict.fromkeys(bands(x))) for x in prints]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fingerprint", "bands"])


def _alike(prints: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of fingerprints whose likeness reaches the bound, as likeness() has it, one row against all at once."""
    levels = np.array([int(x[:2]) for x in prints])
    first, second = [], []
    for level in np.unique(levels):
        own = np.flatnonzero(levels <= level)
        digits = [_thinned(prints[i], int(level)) for i in own]
        sizes = np.array([len(x) for x in digits])
        table = np.zeros((len(own), max(1, sizes.max())), np.uint8)
        for row, x in zip(table, digits, strict=True):
            row[: len(x)] = x
        for k, i in enumerate(own):
            both, most = np.minimum(sizes[k], sizes), np.maximum(sizes[k], sizes)
            same = ((table[k] == table) & (np.arange(table.shape[1]) < both[:, None])).sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(both > 0, (same - both / 16) / (most - both / 16), 0.0)
            hit = own[(score >= least) & (own > i) & (np.maximum(levels[i], levels[own]) == level)]
            first.append(np.full(len(hit), i))
            second.append(hit)
    return np.concatenate(first), np.concatenate(second)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                every = [x["fingerprint"] for x in left + (right or [])]
                keys = np.array([x["k"] for x in left + (right or [])], np.int64)
                for u, v in _forest(keys, *_alike(every, least)):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _narrow(print_: Column) -> Column:
    """A fingerprint in half the bytes: its level, whether its number of digits is odd, and two digits a byte."""
    digits = F.substring(print_, 4, 1 << 30)
    odd = F.length(digits) % 2
    return F.concat(F.unhex(F.concat(F.substring(print_, 1, 2), F.when(odd == 1, "01").otherwise("00"))), F.unhex(F.concat(digits, F.when(odd == 1, "0").otherwise(""))))


def _widened(packed: bytes) -> str:
    digits = packed[2:].hex()
    return f"{packed[:1].hex()}:{digits[:-1] if packed[1] else digits}"


def _pairs_alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(map(_widened, batch.column(i).to_pylist()) for i in (2, 3)), strict=True)
            keep = [likeness(a, b) >= least for a, b in pairs]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(prints: DataFrame, least: float = LIKE, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (k, fingerprint), verified, whose components are those of all pairs that
    share a band and reach the bound.

    Each band's fingerprints are first held against one of them, which joins most near copies with no more pairs than
    members; only bands that still have several components become tiles, to which fingerprints are moved."""
    banded = prints.select("fingerprint").mapInArrow(_banded, "fingerprint string, bands array<bigint>")
    entries = banded.select(F.explode("bands").alias("band"), F.xxhash64("fingerprint").alias("k"))
    # Bands are worked out once and move once: a join of entries with their own counts would do both twice.
    same = W.partitionBy("band")
    met = entries.select("band", "k", F.min("k").over(same).alias("u"), F.max("k").over(same).alias("most"))
    entries = cut(met.filter("u < most").select("band", "k", "u"), "edit-bands")
    pairs = entries.filter("k <> u").select("u", F.col("k").alias("v")).distinct()
    entries = entries.select("band", "k")
    print_of = lambda c: prints.select(F.col("k").alias(c), _narrow(F.col("fingerprint")).alias(f"print_{c}"))
    met = pairs.join(print_of("u"), "u").join(print_of("v"), "v").select("u", "v", "print_u", "print_v")
    edges = cut(met.mapInArrow(_pairs_alike(least), "u bigint, v bigint"), "edit-edges")
    placed = entries.join(components(edges).withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    left = placed.join(several, "band").select("band", "k").join(prints, "k")
    within, across = tile_pairs(left.select("band", F.lit(0).alias("ones"), F.struct("k", "fingerprint").alias("own")), ["band"], "edit", 0, tile)
    # Copies with few edits share many bands: equal tiles are compared once.
    within = within.distinct().withColumn("right", F.lit(None).cast(within.schema["left"].dataType))
    return edges.union(within.union(across).mapInArrow(_verified(least), "u bigint, v bigint")).distinct()


def classes(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """fingerprint, class_id of (doc_id, fingerprint): the smallest doc_id of all whose fingerprints are reachable over
    links; null if none has one. Equal fingerprints are one and are compared once."""
    own = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("k", F.xxhash64("fingerprint"))
    own = cut(own, "edit-distinct")
    roots = components(links(own.select("k", "fingerprint"), least))
    placed = own.join(roots, F.col("k") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "k").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    return placed.join(named, "root").select("fingerprint", "class_id")


def near_copies(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """doc_id, fingerprint and class_id of every row of docs."""
    prints = cut(fingerprints(docs), "edit-prints")
    return prints.join(classes(prints, least), "fingerprint").select("doc_id", "fingerprint", "class_id")


def with_classes(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """SCHEMA and class_id of every row of docs: what near_next gives, and the class of its near copies."""
    rows = cut(near_next(docs), "edit-rows")
    found = classes(rows.select("doc_id", "fingerprint"), least)
    # Fingerprints are told apart by a hash in classes() too: rows meet their classes on it.
    keyed = rows.withColumn("k", F.xxhash64("fingerprint"))
    return keyed.join(found.select(F.xxhash64("fingerprint").alias("k"), "class_id"), "k").drop("k")


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(read(spark, sf_dir, "documents"))
