"""Reading tables, the shared folder, and joins whose small side is counted before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on the bytes that a task hands to Python at once (10,000 rows otherwise, of any width).
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Rows of a small side up to which it is broadcast; beyond it the join is shuffled, and AQE splits skew.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary one; a cluster's
    executors would not see that, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def resolved(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark takes for it: one without is of the default file system, not each machine's own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that later steps don't recompute it. Its shuffles' files go as soon as
    it is written, not when the driver's garbage collector comes to them: a job takes the disk of its largest step. Rows go to
    Python a few MB at a time, so that a task's memory does not grow with the width of 10,000 rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key) for key in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to small, which is broadcast only if its rows, counted first, are no more than most: a number for the
    width of its rows."""
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small, on, how)


def once(df: DataFrame, *columns, keep: int = 0) -> DataFrame:
    """df.select(*columns), worked out once a row: a later filter on dear columns isn't pushed below, where it would work
    them out again. The first `keep` columns are df's own, which stay as they are and go where nobody asks for them."""
    return df.select(*columns[:keep], F.inline(F.array(F.struct(*columns[keep:]))))
