"""Queries that run a stream over the test tables to its end, and read what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.record_queries import event_log
from geoloom.streaming import cards
from geoloom.streaming.months import rewritten_into
from geoloom.tables import read, shared_dir


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream writes to the shared folder until its input is used up."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def st02_card_stream(spark, sf_dir):
    """The card log of st02_card_expiry as a stream with state."""
    log = event_log(_events(spark, sf_dir))
    return _run(cards.answers(log.withColumn("seq", F.col("t").cast("bigint") * 10_000_000 + F.col("seq"))))


def stream_hourly_counts(spark, sf_dir):
    """Events by hour and type; hours close once a later event is a day ahead, and come out once."""
    e = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    g = e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _run(g.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n"))


def st06_monthly_table(spark, sf_dir):
    """A table by month that every batch of events writes its own months of again."""
    at = f"{shared_dir(spark)}/months-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM").alias("month"), "event_id", "event_type", F.col("event_id").alias("version"))
    query = e.writeStream.foreachBatch(rewritten_into(f"{at}/table", ["event_id"])).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/table").groupBy(F.col("month").cast("string").alias("month"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    "st06_monthly_table": (st06_monthly_table, "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "st02_card_stream": (st02_card_stream, None),
    "stream_hourly_counts": (
        stream_hourly_counts,
        """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
    ),
}
