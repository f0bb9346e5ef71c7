"""Exact interpolated quantiles of numbers of any kind, by histograms that are refined where a quantile lies.

A first pass counts values by OCTAVE-ths of a power of two, on either side of zero: some ten thousand buckets at most,
whatever the values. A quantile lies between two ranks, and each rank in one bucket; of these buckets alone a second pass
counts FINE parts of equal width between their least and greatest value, and a third the values in the parts of the ranks.
Buckets rise with the values, by float arithmetic too, so ranks carry over. All counts are summed before they are shuffled;
no group's values are ever held together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.tables import cut, join_checked

OCTAVE, FINE = 16, 1 << 16
#: Powers of two below which no double lies.
_LEAST = 1080


def _bucket(x: Column) -> Column:
    """A whole number that doesn't fall as x rises."""
    size = F.least(F.floor((F.log2(F.abs(x)) + _LEAST) * OCTAVE), F.lit(1 << 20)) + 1
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, size).otherwise(-size).cast("bigint")


def _part(x: Column, least: Column, greatest: Column) -> Column:
    share = (x - least) / F.nullif(greatest - least, F.lit(0.0))
    return F.coalesce(F.least(F.floor(F.when(~F.isnan(share), share) * FINE), F.lit(FINE)).cast("bigint"), F.lit(0).cast("bigint"))


def _found(counts: DataFrame, ranks: DataFrame, by: list[str], place: str) -> DataFrame:
    """ranks with the place (a column of counts beside n) that each rank (from 0) falls in, and the rank within it."""
    before = F.sum("n").over(W.partitionBy(*by).orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    runs = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    met = join_checked(runs, ranks, by).filter((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n")))
    return met.withColumn("rank", F.col("rank") - F.col("_before")).drop("_before", "n")


def quantiles(values: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """keys, p, value of each p of at: of values (keys, x: double), as linear interpolation between the two nearest has it.
    Null and NaN are no values; keys without values have no rows; keys may be null."""
    rows = values.filter(F.col("x").isNotNull() & ~F.isnan("x")).select(*[F.struct(F.col(k)).alias(k) for k in keys], "x").withColumn("_b", _bucket(F.col("x")))
    first = cut(rows.groupBy(*keys, "_b").agg(F.count("*").alias("n"), F.min("x").alias("_least"), F.max("x").alias("_greatest")), "quantiles-buckets")
    sizes = first.groupBy(*keys).agg(F.sum("n").alias("_all"))
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    asked = sizes.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), f(place(p)).cast("bigint").alias("rank"), (place(p) - F.floor(place(p))).alias("_off"))
        for p in at for side, f in ((0, F.floor), (1, F.ceil))
    ])))
    one = cut(_found(first, asked, keys, "_b"), "quantiles-first")

    edges = one.select(*keys, "_b", "_least", "_greatest").distinct()
    within = join_checked(rows, edges, [*keys, "_b"]).withColumn("_f", _part(F.col("x"), F.col("_least"), F.col("_greatest")))
    fine = within.groupBy(*keys, "_b", "_f").agg(F.count("*").alias("n"))
    two = cut(_found(fine, one.drop("_least", "_greatest"), [*keys, "_b"], "_f"), "quantiles-second")

    parts = two.select(*keys, "_b", "_f").distinct()
    last = join_checked(within, parts, [*keys, "_b", "_f"]).groupBy(*keys, "_b", "_f", "x").agg(F.count("*").alias("n"))
    ends = _found(last, two, [*keys, "_b", "_f"], "x").groupBy(*keys, "p").agg(
        F.max(F.when(F.col("side") == 0, F.col("x"))).alias("_lo"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("_hi"), F.max("_off").alias("_off")
    )
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((1 - F.col("_off")) * F.col("_lo") + F.col("_off") * F.col("_hi"))
    return ends.select(*[F.col(k)[k].alias(k) for k in keys], "p", value.alias("value"))
