"""cut() leaves no shuffle files behind, and the session's settings as they were."""

import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.tables import BATCH, CLEANUP, cut


def _shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_cut_frees_its_shuffles(spark):
    before, setting = _shuffled(spark), spark.conf.get(CLEANUP, "false")
    rows = spark.range(10_000).withColumn("k", F.xxhash64("id") % 100).groupBy("k").count()
    found = cut(rows, "freed")
    assert found.agg(F.sum("count")).first()[0] == 10_000
    after = _shuffled(spark) - before
    # The sum above has one shuffle of its own, of a row a task.
    assert len({name.split("_")[1] for name in after}) <= 1
    assert spark.conf.get(CLEANUP, "false") == setting


def test_rows_go_to_python_a_few_megabytes_at_a_time(spark):
    def widths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get(BATCH)
    wide = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('x', 20000) AS text").mapInArrow(widths, "n bigint")
    got = [r.n for r in cut(wide, "wide").collect()]
    assert sum(got) > 30_000_000 and max(got) < 5_000_000
    assert spark.conf.get(BATCH) == before
