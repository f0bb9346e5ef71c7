"""Queries over landed pages: scenes from orders as pages of a hundred, read by the data source, at once or as a stream that
stops and goes on; each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.operators import manifest as M
from geoloom.plans.views import oracle, view
from geoloom.sources import landed
from geoloom.sources.stac import features
from geoloom.tables import resolved, shared_dir

SIZE, FIRST = 100, 3


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to pages of src3 from its page 4 on are signed; those of src5 from its page 1 on lead to another host."""
    scenes = view(spark, sf_dir, "scenes")
    place = F.row_number().over(W.partitionBy("source").orderBy("ord")) - 1
    item = F.to_json(F.struct(F.lit("Feature").alias("type"), "id", F.array("west", "south", "east", "north").alias("bbox"), F.struct("ord", F.col("ts").alias("datetime")).alias("properties")))
    host = F.when((F.col("source") == "src5") & (F.col("page") >= 1), "https://b.example/search?source=").otherwise("https://a.example/search?source=")
    sign = F.when((F.col("source") == "src3") & (F.col("page") >= 4), "&sig=x").otherwise("")
    href = F.concat(F.lit("https://a.example/search?source="), "source", F.lit("&page="), F.col("page").cast("string"))
    link = F.concat(host, "source", F.lit("&page="), (F.col("page") + 1).cast("string"), sign)
    return landed.pages_of(scenes.select("source", place.alias("place"), item.alias("item")), SIZE, href, link)


def _folder(spark: SparkSession) -> str:
    return resolved(spark, f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}")


def src02_page_source(spark, sf_dir):
    """Items of some pages of three sources: folders and pages are chosen before the scan begins."""
    at = _folder(spark)
    landed.land(_pages(spark, sf_dir), f"{at}/pages")
    landed.register(spark)
    pages = spark.read.format("landed_pages").load(f"{at}/pages").filter(F.col("source").isin("src1", "src3", "src5") & (F.col("page") >= 1) & (F.col("page") < 9))
    items = features(pages).select("source", "page", F.get_json_object("item", "$.properties.ord").cast("bigint").alias("ord"))
    return items.groupBy("source", "page").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.sum("ord").alias("sum_ord"))


def _pulled(spark, sf_dir, rounds: int) -> DataFrame:
    """What a pull has brought that stopped after the first three pages had landed, and, of two rounds, went on after all had."""
    at, pages = _folder(spark), _pages(spark, sf_dir)
    into, checkpoint = f"{at}/pulled", landed.checkpoint_for(at, "r1")
    landed.land(pages.filter(F.col("page") < FIRST), f"{at}/pages")
    landed.pull(spark, f"{at}/pages", into, checkpoint)
    if rounds > 1:
        landed.land(pages.filter(F.col("page") >= FIRST), f"{at}/pages")
        landed.pull(spark, f"{at}/pages", into, checkpoint)
    return spark.read.schema(landed.SCHEMA).parquet(into)


def st01_pull_goes_on(spark, sf_dir):
    items = features(_pulled(spark, sf_dir, 2)).select("source", "page", F.get_json_object("item", "$.properties.ord").cast("bigint").alias("ord"))
    return items.groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("ord").alias("items"), F.countDistinct("page").alias("pages"), F.max("page").alias("last_page"), F.sum("ord").alias("sum_ord")
    )


def st01_next_run(spark, sf_dir):
    """What a run after the first would do for each source, by the manifest that the first leaves."""
    last = _pulled(spark, sf_dir, 1).groupBy("source").agg(F.max_by(F.struct("href", "next_href"), "page").alias("l"))
    kind = M.cursor_kind(F.col("l.next_href"), F.col("l.href"), F.lit("GET"))
    failed = F.col("source") == "src6"  # a search that broke off, whose cursor is lost
    manifest = last.select(
        "source", F.when(F.col("source") == "src0", None).otherwise(F.lit("r1")).alias("request_hash"), F.when((kind == "page") & ~failed, F.col("l.next_href")).alias("next_cursor"),
        F.when(failed, "HTTP 500").alias("error"), F.lit(False).alias("cursor_rejected"),
    )
    return M.resumed_from(manifest, F.lit("r1"))


_PAGED = """, placed AS (SELECT source, ord, (row_number() OVER (PARTITION BY source ORDER BY ord) - 1) // 100 AS page FROM scenes),
ends AS (SELECT source, max(page) AS last FROM placed GROUP BY source),
reached AS (SELECT source, CASE source WHEN 'src3' THEN least(last, 4) WHEN 'src5' THEN least(last, 1) ELSE last END AS reach, last FROM ends)"""

QUERIES = {
    "src02_page_source": (
        src02_page_source,
        oracle("scenes", _PAGED + """ SELECT source, page, count(*) AS n, min(ord) AS first_ord, CAST(sum(ord) AS BIGINT) AS sum_ord FROM placed
WHERE source IN ('src1', 'src3', 'src5') AND page BETWEEN 1 AND 8 GROUP BY ALL"""),
    ),
    "st01_pull_goes_on": (
        st01_pull_goes_on,
        oracle("scenes", _PAGED + """ SELECT source, count(*) AS n, count(DISTINCT ord) AS items, count(DISTINCT page) AS pages, max(page) AS last_page, CAST(sum(ord) AS BIGINT) AS sum_ord
FROM placed JOIN reached USING (source) WHERE page <= reach GROUP BY ALL"""),
    ),
    "st01_next_run": (
        st01_next_run,
        oracle("scenes", _PAGED + """, told AS (SELECT source, CASE WHEN least(reach, 2) < last AND NOT (source = 'src5') AND source <> 'src6' THEN 'https://a.example/search?source=' || source || '&page=' || (least(reach, 2) + 1) END AS cursor FROM reached)
SELECT source, CASE WHEN source IN ('src0', 'src6') THEN 'restart' WHEN cursor IS NULL THEN 'exhausted' ELSE 'resume' END AS action, CASE WHEN source <> 'src0' THEN cursor END AS cursor FROM told"""),
    ),
}
