"""Hard negatives by a vector-approximation file.

Tasks pack the rows they read into blocks. In a block each dimension is cut into at most CELLS cells of about as many
rows each; a row's approximation is a byte a dimension, a cell's edges are the least and the greatest value in it. For
an anchor a table holds, of every dimension and cell, the least and the greatest product of its component with a value
of that cell: the sums of what a row's bytes look up are a lower and an upper bound of its score.

Both searches go by these bounds. An anchor's positives: rows of its label whose upper bound is not below the k-th
greatest lower bound. Its negatives: rows of other labels whose bounds meet the window of a positive, and whose upper
bound is not below the k-th greatest lower bound of those that lie in the window for certain. The k-th bound is taken in
a block first, then over all blocks; what is left, and nothing else, fetches its exact vector and is scored.

Rows of one label and vector in a block have one score: only the first of them by vec_id, as many as a list takes and
one more, can stand in a list, so bounds aren't worked out for the others. That loses nothing, at any number of copies.

Arithmetic is exact, by floats where a bound on all sums allows it and by Python's whole numbers beyond.

Defined results: rows with a null label or vector, or with a null or non-finite component, take no part; a shorter
vector is zero beyond its end; rows repeated are rows of their own: an anchor leaves out itself alone, and a positive
that stands twice is two positives; a null vec_id is no anchor, its label stays, and it stands last among ties; equal
ties stand in the order of the table; scores beyond a long stand at its ends; a positive without negatives has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoloom.llm import vectors
from geoloom.llm.tables import cut, join_small, read

CELLS = 256
#: Bytes looked up at once for an anchor: rows of a slice times dimensions.
LOOKED_UP = 1 << 21
_BLOCK = pa.schema(
    [("block", pa.int64()), ("rids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())), ("low", pa.list_(pa.list_(pa.float64()))), ("high", pa.list_(pa.list_(pa.float64())))]
)
BLOCK = "block bigint, rids array<bigint>, labels array<bigint>, codes array<binary>, low array<array<double>>, high array<array<double>>"
BOUNDED = "anchor_rid bigint, rid bigint, low double, high double"
_BOUNDED = pa.schema([("anchor_rid", pa.int64()), ("rid", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


@dataclass(frozen=True)
class Window:
    """least and most: hundredths of the positive's score between which a negative's lies."""

    every: int = 100
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    least: int = 30
    most: int = 90


def cells(values: np.ndarray, most: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each value, and the least and greatest value of each cell."""
    ordered = np.sort(values)
    cuts = np.unique(ordered[np.linspace(0, len(values) - 1, most + 1).astype(int)[1:-1]])
    if len(cuts) < most - 1 and len(distinct := np.unique(ordered)) <= most:
        cuts = distinct[1:]
    code = np.searchsorted(cuts, values, side="right")
    ends = np.searchsorted(ordered, cuts, side="left")
    first, last = np.concatenate([[0], ends]), np.concatenate([ends, [len(values)]]) - 1
    # A first cell below the least cut may be empty: its edges are then those of a cell that no row is in.
    return code.astype(np.uint8), ordered[np.minimum(first, len(values) - 1)], ordered[np.maximum(last, 0)]


def _approximated(copies: int):
    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A block in order of label and vec_id; of rows of one label and vector the first copies."""
        table = pa.Table.from_batches([batch]).sort_by([("label", "ascending"), ("vec_id", "ascending"), ("rid", "ascending")]).combine_chunks()
        v, label = vectors.matrix(table.column("q").chunk(0)), table.column("label").to_numpy()
        key = [label.tobytes()[i * 8 : i * 8 + 8] + (row + 0.0).tobytes() for i, row in enumerate(v)]
        seen: dict[bytes, int] = {}
        keep = []
        for i, k in enumerate(key):
            seen[k] = seen.get(k, 0) + 1
            if seen[k] <= copies:
                keep.append(i)
        v, table = v[keep], table.take(pa.array(keep)).combine_chunks()
        found = [cells(column) for column in v.T]
        rids = table.column("rid").chunk(0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rids[0].as_py()]), vectors.one_list(rids), vectors.one_list(table.column("label").chunk(0)),
                pa.array([[c.tobytes() for c, _, _ in found]], pa.list_(pa.binary())),
                pa.array([[x for _, x, _ in found]], _BLOCK.field("low").type), pa.array([[x for _, _, x in found]], _BLOCK.field("high").type),
            ],
            schema=_BLOCK,
        )

    return pack


class Approximations:
    """A block's bytes and edges, looked up for one anchor after another."""

    def __init__(self, codes: list[bytes], low: list[np.ndarray], high: list[np.ndarray]):
        self.starts = np.cumsum([0, *(len(x) for x in low)])
        self.low, self.high = (np.concatenate(x) if x else np.empty(0) for x in (low, high))
        self.places = np.array([np.frombuffer(c, np.uint8) for c in codes], np.int64).reshape(len(codes), -1)
        self.places += self.starts[:-1, None]
        self.wide = np.diff(self.starts)
        self.most = [max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) for a, b in zip(low, high, strict=True)]

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """The lower and the upper bound of the scores of these rows."""
        n = min(len(anchor), len(self.most))
        kind = vectors.exact_kind(sum(abs(a) * m for a, m in zip(anchor[:n], self.most[:n], strict=True)))
        weight = vectors.typed(np.repeat(anchor[:n], self.wide[:n]), kind)
        a, b = (weight * vectors.typed(x[: self.starts[n]], kind) for x in (self.low, self.high))
        least, most = np.minimum(a, b), np.maximum(a, b)
        places = self.places[:n, rows]
        size = places.shape[1]
        lows, highs = np.zeros(size, kind), np.zeros(size, kind)
        step = max(1, LOOKED_UP // max(1, n))
        for i in range(0, size if n else 0, step):
            part = places[:, i : i + step]
            lows[i : i + step], highs[i : i + step] = least[part].sum(axis=0), most[part].sum(axis=0)
        return lows, highs


def nth_greatest(values: np.ndarray, n: int):
    """The n-th greatest; None of fewer."""
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else None


def _rounded(bounds: np.ndarray, up: bool) -> list[float]:
    """Bounds as floats that don't lie within what they bound."""
    if bounds.dtype != object:
        return bounds.astype(np.float64)
    near = np.array([float(x) for x in bounds])
    return np.nextafter(near, np.inf if up else -np.inf)


def _bounded(choose):
    """Rows of a block that may be in an anchor's list: choose(blocks' labels, bounds, anchor) gives their places and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rids, labels = batch.column("rids")[i].values.to_numpy(), batch.column("labels")[i].values.to_numpy()
                block = Approximations(
                    [c.as_py() for c in batch.column("codes")[i].values], *([x.values.to_numpy() for x in batch.column(k)[i].values] for k in ("low", "high"))
                )
                for anchor in batch.column("asked")[i].values:
                    places, low, high = choose(labels, block, anchor)
                    if len(places):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(anchor["rid"].as_py(), pa.int64()), len(places)), pa.array(rids[places]), pa.array(_rounded(low, False)), pa.array(_rounded(high, True))],
                            schema=_BOUNDED,
                        )

    return run


def _together(run, rows: int = 20_000):
    """Its many small batches as larger ones."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _same_label(k: int):
    """Rows of the anchor's label whose upper bound reaches the k-th greatest lower bound (one more, for itself)."""

    def choose(labels, block, anchor):
        own = anchor["label"].as_py()
        rows = slice(np.searchsorted(labels, own, "left"), np.searchsorted(labels, own, "right"))
        low, high = block.bounds(anchor["q"].values.to_numpy(), rows)
        least = nth_greatest(low, k + 1)
        keep = np.arange(len(low)) if least is None else np.flatnonzero(high >= least)
        return keep + rows.start, low[keep], high[keep]

    return choose


def _other_labels(k: int):
    """Rows of other labels that may be among the first k of one of the anchor's windows."""

    def choose(labels, block, anchor):
        own, n = anchor["label"].as_py(), len(labels)
        v = anchor["q"].values.to_numpy()
        start, end = np.searchsorted(labels, own, "left"), np.searchsorted(labels, own, "right")
        sides = [block.bounds(v, rows) for rows in (slice(0, start), slice(end, n))]
        low, high = (np.concatenate([s[j] for s in sides]) for j in (0, 1))
        keep = np.zeros(len(low), bool)
        for window in anchor["windows"].as_py():
            may = (high >= window["least"]) & (low <= window["most"])
            sure = nth_greatest(low[may & (low >= window["least"]) & (high <= window["most"])], k)
            keep |= may if sure is None else may & (high >= sure)
        places = np.flatnonzero(keep)
        return np.where(places < start, places, places + end - start), low[places], high[places]

    return choose


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = vectors.matrix(batch.column("aq")), vectors.matrix(batch.column("q"))
        n = min(a.shape[1], b.shape[1])
        a, b = a[:, :n], b[:, :n]
        kind = vectors.exact_kind(float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n)
        score = (vectors.typed(a, kind) * vectors.typed(b, kind)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor_rid", "rid", "vec_id")), vectors.longs(score)], names=["anchor_rid", "rid", "vec_id", "score"])


def exact(found: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_rid, rid, vec_id, score of the pairs (anchor_rid, rid) that the bounds left."""
    pairs = found.select("anchor_rid", "rid").join(rows.select("rid", "vec_id", "q"), "rid")
    pairs = pairs.join(anchors.select(F.col("rid").alias("anchor_rid"), F.col("q").alias("aq")), "anchor_rid")
    return pairs.mapInArrow(_scored, "anchor_rid bigint, rid bigint, vec_id bigint, score bigint")


def _ranked(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")))


def _above(found: DataFrame, by: list[str], sure, k: int) -> DataFrame:
    """Of found (low, high) what reaches the k-th greatest low of the sure rows of its group."""
    order = W.partitionBy(*by).orderBy(F.desc("low"))
    kth = found.filter(sure).withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).groupBy(*by)
    kth = kth.agg(F.max("_nth").alias("_n"), F.min("low").alias("_kth")).filter(F.col("_n") == k).select(*by, "_kth")
    return found.join(kth, by, "left").filter(F.col("_kth").isNull() | (F.col("high") >= F.col("_kth"))).drop("_kth")


def mine(table: DataFrame, window: Window = Window(), block: int = vectors.BLOCK) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of table (vec_id, embedding, label)."""
    q = vectors.whole(F.col("embedding"), window.scale).alias("q")
    fit = table.select("vec_id", q, F.col("label").cast("bigint").alias("label")).filter("q IS NOT NULL AND label IS NOT NULL")
    rows = vectors.numbered(fit, "negatives-rows")
    copies = max(window.positives + 1, window.negatives)
    blocks = cut(vectors.packed(rows, _approximated(copies), BLOCK, block), "negatives-blocks")
    anchors = rows.filter(F.col("vec_id") % window.every == 0)

    same = vectors.met(blocks, anchors, ["rid", "label", "q"], _together(_bounded(_same_label(window.positives))), BOUNDED)
    same = _above(cut(same.filter("anchor_rid <> rid"), "negatives-same"), ["anchor_rid"], F.lit(True), window.positives)
    positives = _ranked(exact(same, rows, anchors), "anchor_rid").filter(F.col("rank") <= window.positives)
    least, most = (F.lit(x).cast("decimal(5,0)") * F.col("score").cast("decimal(20,0)") / 100 for x in (window.least, window.most))
    # Scores are whole: the window's edges are the whole numbers within it.
    positives = positives.select(
        "anchor_rid", F.col("rid").alias("positive_rid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.ceil(least).cast("bigint").alias("least"), F.floor(most).cast("bigint").alias("most"),
    ).filter("least <= most")
    positives = cut(positives, "negatives-positives")

    windows = positives.groupBy(F.col("anchor_rid").alias("rid")).agg(F.collect_set(F.struct("least", "most")).alias("windows"))
    asking = cut(anchors.join(windows, "rid"), "negatives-asking")
    other = cut(vectors.met(blocks, asking, ["rid", "label", "q", "windows"], _together(_bounded(_other_labels(window.negatives))), BOUNDED), "negatives-other")
    spans = positives.select("anchor_rid", "least", "most").distinct()
    within = join_small(other, spans, ["anchor_rid"], "inner").filter("high >= least AND low <= most")
    left = _above(within, ["anchor_rid", "least", "most"], F.expr("low >= least AND high <= most"), window.negatives)
    scored = exact(left.select("anchor_rid", "rid").distinct(), rows, asking)
    listed = join_small(scored, positives, ["anchor_rid"], "inner").filter("score BETWEEN least AND most")
    listed = _ranked(listed, "anchor_rid", "positive_rid").filter(F.col("rank") <= window.negatives)
    named = listed.join(asking.select(F.col("rid").alias("anchor_rid"), F.col("vec_id").alias("anchor_id")), "anchor_rid")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return mine(table.withColumn("label", moved))


OP13_SQL = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
positives AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id ASC NULLS LAST, b) AS nth FROM scored WHERE same QUALIFY nth <= 5),
found AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id ASC NULLS LAST, n.b) AS rank
    FROM positives p JOIN scored n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""
