"""A table by month that is kept up to date by a stream: a batch writes again the months it has rows of, and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewritten_into(path: str, keys: list[str]):
    """For foreachBatch: rows have a month, a version and keys. The months of a batch are read, the row of the largest
    version is kept for each key, and those months' folders are written anew; a batch that is run again changes nothing.
    A month is first written beside the table, as a table can't be read and written at once."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        months = [r[0] for r in rows.select("month").distinct().collect()]  # as many as a batch spans
        try:
            if not months:
                return
            every = rows
            try:
                old = spark.read.schema(rows.schema).parquet(path)
            except Exception as none:  # the first batch finds no table
                if "PATH_NOT_FOUND" not in str(none):
                    raise
            else:
                every = rows.unionByName(old.filter(F.col("month").isin(months)))
            rest = [c for c in rows.columns if c not in (*keys, "month")]
            best = every.groupBy("month", *keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select("month", *keys, "r.*")
            beside = f"{path}-batch-{batch}"
            best.write.mode("overwrite").parquet(beside)
            spark.read.schema(best.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
        finally:
            rows.unpersist()

    return write
