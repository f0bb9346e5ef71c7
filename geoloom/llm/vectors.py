"""Whole-number vectors in blocks, for searches of a query set against all rows.

Every row gets a number of its own, so that rows of one vec_id are told apart. Tasks pack the rows they read into blocks
of at most BLOCK rows; queries are dealt into blocks by a hash of that number. Each block of queries meets each block of
rows by an equal join on the pair of their places in a grid, whose sides follow from counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.tables import cut

#: Rows of a block, and queries of a block (a mean: they are dealt by a hash).
BLOCK, QUERIES = 1 << 16, 2048
#: Whole numbers up to here are exact as floats of four and of eight bytes.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64))
LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; null for a vector that is null or holds a component that is null
    or, scaled, not finite."""
    scaled = F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # rint after floor: floor gives a long, which ends at 2 ** 63.
    return F.when(fine, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows (with a vector q) with a number rid each, written once: later reads see the same numbers."""
    return cut(rows.withColumn("rid", F.monotonically_increasing_id()), name)


def matrix(vectors: pa.Array) -> np.ndarray:
    """A row for each list of doubles; shorter ones are zero beyond their ends."""
    ends = vectors.offsets.to_numpy()
    sizes, flat = np.diff(ends), vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def exact_kind(bound: float):
    """The smallest type whose sums up to bound are exact; Python's whole numbers beyond."""
    return next((kind for most, kind in EXACT if bound < most), object)


def typed(values: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)
    return values.astype(kind)


def longs(scores) -> pa.Array:
    """Scores as longs; those beyond the range of a long stand at its ends."""
    return pa.array([min(max(int(s), LONG[0]), LONG[1]) for s in scores], pa.int64())


def one_list(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def packed(rows: DataFrame, pack: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, size: int = BLOCK) -> DataFrame:
    """rows in blocks: pack turns up to size rows of one task into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == size:
                    yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, schema)


def met(blocks: DataFrame, queries: DataFrame, columns: list[str], run, schema: str, per: int = QUERIES) -> DataFrame:
    """run over every block of rows beside every block of queries (arrays of the named columns; rid first).

    The grid is as wide as there are blocks of rows and as high as queries fill blocks; a place in it is a key of the
    equal join, and each place is one of a fixed number of partitions. Both tables are written before, so counts are cheap."""
    spark = blocks.sparkSession
    wide, n = max(1, blocks.count()), queries.count()
    high = -(-n // per)
    if not high:
        return spark.createDataFrame([], schema)
    dealt = queries.withColumn("h", F.pmod(F.xxhash64("rid"), F.lit(high))).groupBy("h").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
    places = min(wide * high, 1 << 15)
    left = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(wide))).withColumn("h", every(high)).repartition(places, "g", "h")
    right = dealt.withColumn("g", every(wide)).repartition(places, "g", "h")
    return left.join(right.hint("shuffle_hash"), ["g", "h"]).mapInArrow(run, schema)
