"""A manifest kept up to date by a stream of source rows: each batch is merged into the version before it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoloom.operators.manifest import merged


def version(path: str, batch: int) -> str:
    return f"{path}/v{batch:08d}"


def upsert_into(path: str):
    """For foreachBatch: batch n writes version n from version n - 1. A batch that is run again writes the same version
    again, so a restart loses and doubles nothing. A batch has at most one row a source."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        old = spark.read.parquet(version(path, batch - 1)) if batch else rows.limit(0)
        merged(old, rows).write.mode("overwrite").parquet(version(path, batch))

    return write
