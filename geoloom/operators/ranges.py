"""Spans of bytes that lie close together, as one span each, and the tiles that a window needs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes between spans that are read along, and bytes of one read at most.
GAP, MOST = 8_192, 8 * 1_024 * 1_024


def coalesced(spans: DataFrame, keys: list[str], gap: int = GAP, most: int | None = MOST, block: int = 1 << 26) -> DataFrame:
    """keys, start, stop, n of runs of spans (start, stop, half open) whose gaps are at most `gap`, in reads of no more
    than `most` bytes; a span that is longer by itself is a read.

    Equal spans are counted as one first. Spans are ordered within blocks of places, and runs are then joined across
    blocks: a file of any length is many tasks' work in the first step. The reads of a run follow from one another, so
    each run that is longer than `most` is cut in one pass over its spans, in order."""
    own = spans.groupBy(*keys, "start", "stop").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("start") / block))
    runs = _runs(_runs(own, [*keys, "_block"], gap), keys, gap)
    if most is None:
        return runs
    short = runs.filter(F.col("stop") - F.col("start") <= most)
    long = runs.filter(F.col("stop") - F.col("start") > most).select(*keys, F.col("start").alias("_run"), F.col("stop").alias("_end"))
    # Which run a span lies in, by the blocks that the run reaches over: no more than block / most runs begin in a block.
    reached = F.sequence(F.floor(F.col("_run") / block), F.floor((F.col("_end") - 1) / block))
    met = own.join(long.select(*keys, "_run", "_end", F.explode(reached).alias("_block")), [*keys, "_block"])
    placed = met.filter((F.col("_run") <= F.col("start")) & (F.col("stop") <= F.col("_end")))
    schema = placed.select(*keys, "start", "stop", "n").schema

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs come whole and in order: one read is held at a time."""
        name, read = None, None
        for df in batches:
            out = []
            for row in df.itertuples(index=False):
                own, start, stop, n = tuple(row[: len(keys) + 1]), row.start, row.stop, row.n
                if own == name and max(read[1], stop) - read[0] <= most:
                    read = (read[0], max(read[1], stop), read[2] + n)
                    continue
                if read is not None:
                    out.append((*name[: len(keys)], *read))
                name, read = own, (start, stop, n)
            yield pd.DataFrame(out, columns=schema.names)
        if read is not None:
            yield pd.DataFrame([(*name[: len(keys)], *read)], columns=schema.names)

    ordered = placed.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "start", "stop").select(*keys, "_run", "start", "stop", "n")
    return short.unionByName(ordered.mapInPandas(cut, schema))


def _runs(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach + gap, 0).otherwise(1)
    marked = spans.withColumn("_fresh", fresh)
    runs = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("_run")


def tiles_of(low: Column, high: Column, size: int, whole: Column) -> Column:
    """(first, last) of the tiles along one axis of `whole` pixels that the pixels from low to before high lie in; null if
    none does."""
    a, b = F.greatest(low, F.lit(0)), F.least(high, whole)
    place = lambda c: F.floor(c / size).cast("int")
    return F.when(a < b, F.struct(place(a).alias("first"), place(b - 1).alias("last")))
