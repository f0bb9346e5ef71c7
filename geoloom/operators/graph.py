"""Connected components of links by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.tables import cut

#: A guard: rounds grow with the logarithm of a component's width.
MOST_ROUNDS = 60


def _digest(links: DataFrame) -> tuple:
    """Two numbers by which sets of links are told apart."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that can be reached) of every node of links (u, v).

    Joins are by sorted shuffles: what `cut` has written looks small, as it is compressed, and would be broadcast round by
    round by way of the driver."""
    spark = links.sparkSession
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(links.filter("u <> v").select(*pair("u", "v")).distinct(), "links")
    said = _digest(now)
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours hang on the least of the neighbourhood.
        large = both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and all smaller neighbours hang on the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").select(*pair("u", "v")).distinct(), "links")
        said, before, now = _digest(after), said, after
        if said == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
    raise RuntimeError(f"{spark.sparkContext.appName}: components did not settle")
