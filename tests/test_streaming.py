"""Streams in several batches against the same work in one."""

from pyspark.sql import functions as F

from geoloom.operators import cards, manifest
from geoloom.plans import record_queries
from geoloom.streaming import cards as card_stream
from geoloom.streaming.manifest import upsert_into, version

SF = "/root/testdata/sf0.001"


def test_cards_over_batches(spark, tmp_path):
    log = record_queries._log(spark, SF).withColumn("seq", F.col("t").cast("bigint") * 10_000_000 + F.col("seq")).cache()
    bounds = log.approxQuantile("seq", [0.3, 0.7], 0.0)
    for k, cond in enumerate((F.col("seq") <= bounds[0], (F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1]), F.col("seq") > bounds[1])):
        log.filter(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = card_stream.answers(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, cards.replay(log).collect()))


def test_manifest_versions(spark, tmp_path):
    write = upsert_into(str(tmp_path))
    row = lambda s, n, saved: (s, n, "h", "c", None, None, False, saved, saved, [], [], [], [])
    batches = [[row("a", 1, ["x"]), row("b", 2, ["y"])], [row("a", 9, ["z"])]]
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, manifest.SCHEMA), n)
    write(spark.createDataFrame(batches[1], manifest.SCHEMA), 1)
    got = {r.source: (r.ord, r.saved) for r in spark.read.parquet(version(str(tmp_path), 1)).collect()}
    assert got == {"a": (1, ["x", "z"]), "b": (2, ["y"])}


def test_landed_pages_lie_in_small_ordered_row_groups(spark, tmp_path):
    """A reader of a run of pages holds a few MB, whatever the size of a file."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from geoloom.sources import landed

    value = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(800)), lambda x: F.sha2(F.concat_ws(" ", "id", x).cast("binary"), 256)), "")
    pages = spark.range(400).orderBy(F.hash("id")).coalesce(1).select(F.lit("s").alias("source"), F.col("id").alias("page"), F.lit("h").alias("href"), F.lit(None).cast("string").alias("next_href"), value.alias("value"))
    landed.land(pages, str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("source=s/*.parquet")
    held = pq.ParquetFile(file)
    assert held.num_row_groups > 2 and held.read(["page"])["page"].to_pylist() == list(range(400))
    got = [p for b in landed._read(str(tmp_path / "p"), landed.Pages("s", 100, 163)) for p in b.column(1).to_pylist()]
    assert sorted(got) == list(range(100, 164))
