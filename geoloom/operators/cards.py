"""Scene cards: one compact record a catalog entry; and what a store with expiry answers over a log of puts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.text import index_id

#: Kinds that have no cloud cover.
NO_CLOUD = "sar lidar dem atmosphere detection altimetry precipitation landcover landsurface".split()
VERSION = 1
TTL, MAX_AGE = 300.0, 1800.0


def cloud_status(kind: Column, cloud: Column) -> Column:
    return F.when(kind.isin(NO_CLOUD), "not_applicable").when(cloud.isNull(), "unknown").otherwise("value")


def first_text(*values: Column) -> Column:
    """The first of them that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def cards(scenes: DataFrame, satellites: DataFrame) -> DataFrame:
    """A card of every scene whose source has a satellite. satellites: source, satellite."""
    from geoloom.tables import join_checked

    named = satellites.select("source", F.lower(F.trim("satellite")).alias("satellite")).filter("satellite <> ''")
    status = cloud_status(F.col("kind"), F.col("cloud"))
    return join_checked(scenes, named, ["source"]).select(
        F.lit(VERSION).alias("card_version"),
        index_id(F.col("source"), F.col("collection"), F.col("id")).alias("index_id"),
        "source", "collection", F.col("id").alias("provider_id"), "satellite", "kind", "ts", "west", "south", "east", "north",
        status.alias("cloud_status"),
        F.when(status == "value", F.col("cloud")).alias("cloud"),
        "ord",
    )


def found_in(source: Column, others: Column) -> Column:
    """The card's own source, then the other ones, each once."""
    return F.array_distinct(F.concat(F.array(source), F.coalesce(others, F.array().cast("array<string>"))))


def has_local_data(layers: Column) -> Column:
    """layers: map of name to availability (absent, windowed or full)."""
    return F.exists(F.map_values(layers), lambda a: a != "absent")


def replay(log: DataFrame, ttl: float = TTL, max_age: float = MAX_AGE) -> DataFrame:
    """seq, index_id, status (found, expired or missing) of every lookup in a log (seq, t, op, index_id).

    A card lives for ttl seconds after it was put or last found, never longer than max_age after it was put; at the very
    end of either it has expired. What follows a put is a run of its own; within it, lookups are found up to the first
    that comes too late after the event before it or after the put. Three running values over a card's events in order,
    which stream through a window: no list is gathered."""
    put = F.col("op") == "put"
    order = W.partitionBy("index_id").orderBy("seq")
    runs = log.select(F.col("seq").cast("bigint").alias("seq"), F.col("t").cast("double").alias("t"), "op", "index_id")
    runs = runs.withColumn("run", F.count_if(put).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.withColumn("since", F.max(F.when(put, F.col("t"))).over(W.partitionBy("index_id", "run")))
    within = W.partitionBy("index_id", "run").orderBy("seq")
    late = (F.col("t") - F.lag("t").over(within) >= ttl) | (F.col("t") - F.col("since") >= max_age)
    lapsed = F.max(F.coalesce(F.col("late"), F.lit(False))).over(within.rowsBetween(W.unboundedPreceding, 0))
    status = F.when(F.col("run") == 0, "missing").when(F.col("lapsed"), "expired").otherwise("found")
    return runs.withColumn("late", late).withColumn("lapsed", lapsed).filter("op <> 'put'").select("seq", "index_id", status.alias("status"))


def listed(cards: DataFrame) -> DataFrame:
    """Cards in the order of a list: by time, then id."""
    return cards.orderBy("ts", "index_id")
