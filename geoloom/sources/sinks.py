"""Tables that are written: once, or one record more; and weights that are read only if they are what they should be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layout of a record of a run that this library reads.
TRACE_VERSION = 1


def write_new(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table in a place of its own: one that is there already is an error, unless it is to be replaced."""
    table.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Events, one JSON object a line, behind those that are there: time, event and whatever else they have."""
    events.withColumn("time", F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).write.mode("append").json(path)


def write_traces(runs: DataFrame, path: str) -> None:
    """Runs (run_id, run: JSON text) with the version of their layout."""
    runs.withColumn("schema_version", F.lit(TRACE_VERSION)).write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, version: int = TRACE_VERSION) -> DataFrame:
    """Runs whose layout this library reads; one of another layout, or that is no JSON object, is left out."""
    rows = spark.read.schema("run_id string, run string, schema_version int").option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("schema_version") == version).select("run_id", "run")


def pinned(weights: DataFrame, pins: DataFrame, allow_unpinned: bool = False) -> DataFrame:
    """name, path of the weights (name, path, content) whose digest is their pin (name, sha256). Weights without a pin, or
    with an empty one, are left out, unless that is allowed."""
    pin = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    held = weights.join(pins, "name")
    fits: Column = F.sha2("content", 256) == pin
    return held.filter(fits | ((pin == "") & F.lit(allow_unpinned))).select("name", "path")
