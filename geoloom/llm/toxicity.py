"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the lower-cased text between spaces, present or not. Their document counts by class,
summed over the training rows, give each a log-count ratio r; those whose counts differ between the classes by min_z
standard errors or more are the model's features, all of them. Features share 2 ** BITS buckets by a hash, which is the
model's size; two n-grams of one bucket are one feature. A logistic regression is then fitted on r times presence by gradient steps, each a sum over the training rows'
kept features, and every whole text is scored by its distinct kept features.

Learning reads labels only of rows outside the held-out fifth, at most about MAX_TRAIN of them by a hash of doc_id
(a documented bound on the fit alone; every row is scored). With no labelled rows, or of one class only, every score
is the share of label 1 among them (0.0 of none).

Defined results: a null text is an empty one and has the score of the intercept; rows repeated are scored alike; a
null doc_id is not trained on and counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, read

ORDERS = (3, 4, 5)
BITS = 20
#: Labelled rows that the fit reads at most, in expectation.
MAX_TRAIN = 20_000
#: Partitions that these rows' sums come from at most: what a step sends to the driver is so many vectors.
PARTS = 16
#: Characters whose features are worked out at once.
BLOCK = 1 << 20
_PAD = max(ORDERS) - 1


@dataclass(frozen=True)
class Settings:
    """min_z is the selection of features, a parameter of the model; nothing else leaves any out."""

    smoothing: float = 1.0
    min_z: float = 4.0
    l2: float = 2e-3
    steps: int = 25


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each point (the last _PAD points excepted)."""
    n = len(points) - _PAD
    if n <= 0:
        return
    h = points[:n].copy()
    for k in range(1, max(ORDERS)):
        h *= np.uint32(0x01000193)
        h += points[k : k + n]
        if k + 1 in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            mixed *= np.uint32(0x85EBCA6B + 2 * k)
            yield mixed >> np.uint32(32 - BITS)


def _padded(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Blocks of whole texts, each after _PAD spaces, with the bounds of the texts in them. A text longer than a
    block comes in pieces that overlap by _PAD."""
    gap = " " * _PAD
    rows, pieces, length = [], [], 0

    def block():
        joined = "".join(pieces) + gap
        return rows, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()

    for i, text in enumerate(texts):
        text = gap + (text or "").lower()
        for at in range(0, len(text), BLOCK):
            piece = text[max(0, at - _PAD) : at + BLOCK] if at else text[:BLOCK]
            # A piece's own grams end where the next one's begin.
            rows.append((i, length, length + len(piece)))
            pieces.append(piece)
            length += len(piece)
            if length >= BLOCK:
                yield block()
                rows, pieces, length = [], [], 0
    if rows:
        yield block()


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> list[np.ndarray]:
    """The distinct buckets of each text; with wanted (a flag for each bucket) of those alone."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, points in _padded(texts):
        for grams in _grams(points):
            if wanted is None:
                for i, a, b in rows:
                    found[i].append(np.unique(grams[a:b]))
            else:
                at = np.flatnonzero(wanted[grams])
                hit = grams[at]
                edges = np.searchsorted(at, [x for _, a, b in rows for x in (a, b)])
                for (i, _, _), a, b in zip(rows, edges[::2], edges[1::2], strict=True):
                    if b > a:
                        found[i].append(hit[a:b])
    empty = np.empty(0, np.uint32)
    return [np.unique(np.concatenate(x)) if x else empty for x in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have each bucket, over one partition: sparse, and summed before it leaves."""
    total, seen = np.zeros((2, 1 << BITS), np.int64), 0
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        seen += len(labels)
        for label, own in zip(labels, features(batch.column("text").to_pylist()), strict=True):
            total[label][own] += 1
    if seen:
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "n0", "n1"]
        )


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """text, toxic (0 or 1) of labelled rows that are not held out, about limit of them at most."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > limit:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", "toxic")


@dataclass(frozen=True)
class Model:
    """buckets (sorted), their weights (log-count ratio times coefficient) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.buckets] = self.weights
        return full


def ratios(summed: DataFrame, n0: int, n1: int, settings: Settings) -> DataFrame:
    """bucket and log-count ratio r of (bucket, n0, n1), documents of each class that have it, for those kept: bounded by
    the number of buckets."""
    a = settings.smoothing
    p, q = (F.col("n1") + a) / (n1 + 2 * a), (F.col("n0") + a) / (n0 + 2 * a)
    pool = (F.col("n0") + F.col("n1") + 2 * a) / (n0 + n1 + 4 * a)
    z = (p - q) / F.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1) + 1e-12)
    return summed.select("bucket", F.log(p / q).alias("r"), F.abs(z).alias("z")).filter(F.col("z") >= settings.min_z).select("bucket", "r")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), limit: int = MAX_TRAIN) -> Model:
    spark = docs.sparkSession
    rows = cut(training_rows(docs, labels, limit), "toxic-train").coalesce(PARTS)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    none = np.empty(0, np.int64)
    if not n0 or not n1:
        share = min(max((n1 / (n0 + n1)) if n0 + n1 else 0.0, 1e-9), 1 - 1e-9)
        return Model(none, none.astype(float), float(np.log(share / (1 - share))))
    summed = (
        rows.mapInArrow(_counts, "bucket int, n0 bigint, n1 bigint")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )
    best = ratios(summed, n0, n1, settings).toPandas().sort_values("bucket")
    buckets, r = best["bucket"].to_numpy(np.int64), best["r"].to_numpy(float)
    prior = float(np.log(n1 / n0))
    if not len(buckets):
        return Model(buckets, r, prior)
    flags = np.zeros(1 << BITS, bool)
    flags[buckets] = True
    place = np.zeros(1 << BITS, np.int32)
    place[buckets] = np.arange(len(buckets))
    shared = spark.sparkContext.broadcast((flags, place))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, place = shared.value
        for batch in batches:
            own = [place[x] for x in features(batch.column("text").to_pylist(), flags)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.list_(pa.int32())), batch.column("toxic")], names=["own", "toxic"]
            )

    sparse = cut(rows.mapInArrow(kept, "own array<int>, toxic int"), "toxic-sparse").coalesce(PARTS)
    # Coefficients of r times presence: 1 is naive Bayes itself, from which the steps start.
    w, b = _descend(sparse, r, prior, n0 + n1, settings)
    return Model(buckets, w * r, b)


def _descend(sparse: DataFrame, r: np.ndarray, prior: float, n: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps with a step length that adapts: each step is one pass over
    the sparse rows, from which one dense vector a partition comes back."""
    spark, m = sparse.sparkSession, len(r)

    def gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast((x[:m] * r, x[m]))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b = shared.value
            g, loss, bias, seen = np.zeros(m), 0.0, 0.0, 0
            for batch in batches:
                own, y = batch.column("own"), batch.column("toxic").to_numpy(zero_copy_only=False)
                at, starts = own.values.to_numpy(), own.offsets.to_numpy()
                which = np.repeat(np.arange(len(y)), np.diff(starts))
                s = b + np.bincount(which, w[at], len(y))
                off = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
                loss += float(np.logaddexp(0, np.where(y == 1, -s, s)).sum())
                g += np.bincount(at, off[which], m)
                bias += float(off.sum())
                seen += len(y)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([loss]), pa.array([bias]), pa.array([g.tobytes()])], names=["loss", "bias", "g"]
                )

        parts = sparse.mapInArrow(part, "loss double, bias double, g binary").collect()
        shared.unpersist()
        g = np.append(sum(np.frombuffer(p["g"]) for p in parts) * r, sum(p["bias"] for p in parts)) / n
        g[:m] += settings.l2 * x[:m]
        return sum(p["loss"] for p in parts) / n + settings.l2 / 2 * float(x[:m] @ x[:m]), g

    x = np.append(np.zeros(m), prior)
    loss, g = gradient(x)
    step, last = 1.0 / max(1e-9, float(np.linalg.norm(g))), None
    for _ in range(settings.steps):
        new = x - step * g
        new_loss, new_g = gradient(new)
        if new_loss > loss + 1e-12 and new_loss > (last or loss):
            step /= 4
            continue
        s, d = new - x, new_g - g
        x, g, last, loss = new, new_g, loss, new_loss
        curve = float(s @ d)
        # Barzilai and Borwein's step length.
        step = float(s @ s) / curve if curve > 1e-15 else 2 * step
        if float(np.abs(g).max()) < 1e-5:
            break
    return x[:m], float(x[m])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        flags = weights != 0
        for batch in batches:
            sums = np.array([weights[x].sum(dtype=np.float64) for x in features(batch.column("text").to_pylist(), flags)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -30, 30))), pa.float64())],
                names=["doc_id", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5) of every row of docs."""
    scored = score(docs, fit(docs, labels, settings))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
