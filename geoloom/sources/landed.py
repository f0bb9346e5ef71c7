"""Landed pages of searches as a Spark data source, batch and stream.

A landing folder holds Parquet with a row for each page: source (a folder each), page (0, 1, ... of a source), href (the
request the page answers), next_href (its link to the next page, if any) and value (the page, a FeatureCollection).

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").load(path)        # or spark.readStream

Batch: a partition is a run of a source's pages. Filters on source and page are pushed: they choose folders and pages
before any task starts, and Spark doesn't test them again.

Stream: the offset is the cursor of each source: the number of pages that have been followed, the link to go on from, and
the state: `open` (the next page is still to land), `exhausted` (the last page has no link) or `refused` (its link isn't
one to keep: signed, of another host, or the search itself again). A page comes once its predecessor's link leads to it,
so that what lies behind a refused link never comes. Spark writes offsets before it reads and knows them after a restart: no page is lost or
doubled. A run of another request has a checkpoint of its own, and so begins with the first pages (`checkpoint_for`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from geoloom.functions.text import SIGNED_KEYS, SIGNED_PREFIXES

SCHEMA = "source string, page bigint, href string, next_href string, value string"
_NAMES = ["source", "page", "href", "next_href", "value"]
#: Pages of a partition.
RUN = 64
#: Bytes of a row group of landed pages.
BLOCK = 4 << 20


def _dataset(path: str) -> ds.Dataset:
    files, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    kinds = pa.schema([("source", pa.string()), ("page", pa.int64()), ("href", pa.string()), ("next_href", pa.string()), ("value", pa.string())])
    return ds.dataset(at, filesystem=files, schema=kinds, format="parquet", partitioning=ds.partitioning(pa.schema([("source", pa.string())]), flavor="hive"))


@dataclass
class Pages(InputPartition):
    """Pages first to last of a source."""

    source: str
    first: int
    last: int


def _read(path: str, part: Pages) -> Iterator[pa.RecordBatch]:
    wanted = (ds.field("source") == part.source) & (ds.field("page") >= part.first) & (ds.field("page") <= part.last)
    # One row group at a time: by itself the scanner reads many files ahead, whole.
    plain = ds.ParquetFragmentScanOptions(pre_buffer=False)
    for batch in _dataset(path).to_batches(columns=_NAMES, filter=wanted, batch_size=RUN, batch_readahead=1, fragment_readahead=1, fragment_scan_options=plain, use_threads=False):
        if batch.num_rows:
            yield batch


def _runs(source: str, first: int, last: int) -> list[Pages]:
    return [Pages(source, low, min(low + RUN - 1, last)) for low in range(first, last + 1, RUN)]


class PageReader(DataSourceReader):
    _KINDS = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}

    def __init__(self, path: str):
        self.path, self.pushed = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.attribute in (("source",), ("page",)) and type(f) in (*self._KINDS, In):
                self.pushed.append(f)
            else:
                yield f

    def _wanted(self) -> ds.Expression | None:
        every = None
        for f in self.pushed:
            column = ds.field(f.attribute[0])
            one = column.isin(list(f.value)) if isinstance(f, In) else getattr(column, self._KINDS[type(f)])(f.value)
            every = one if every is None else every & one
        return every

    def partitions(self) -> list[Pages]:
        found: dict[str, list[int]] = {}
        for batch in _dataset(self.path).to_batches(columns=["source", "page"], filter=self._wanted()):
            for source, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = found.get(source, (page, page))
                found[source] = [min(low, page), max(high, page)]
        return [p for source, (low, high) in sorted(found.items()) for p in _runs(source, low, high)] or [Pages("", 0, -1)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


def keepable(link: str, href: str) -> bool:
    """Whether a link to the next page may be stored: not signed, of the same origin, and not the search itself again."""
    a, b = urlsplit(link), urlsplit(href)
    keys = [k.lower() for k, _ in parse_qsl(a.query, keep_blank_values=True)]
    signed = any(k in SIGNED_KEYS or k.startswith(SIGNED_PREFIXES) for k in keys)
    return not signed and (a.scheme.lower(), a.netloc.lower()) == (b.scheme.lower(), b.netloc.lower()) and link != href


class PageStream(DataSourceStreamReader):
    """Cursors by source: {source: {"pages": followed, "cursor": link or None, "state": ...}}."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Links only are read, and of each source only those of pages that are not yet known to be followed."""
        links: dict[str, dict[int, tuple[str, str | None]]] = {}
        least = min((c["pages"] for c in self.known.values()), default=0)
        for batch in _dataset(self.path).to_batches(columns=_NAMES[:4], filter=ds.field("page") >= least - 1 if least else None):
            for source, page, href, link in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                links.setdefault(source, {})[page] = (href, link)
        for source, pages in links.items():
            now = dict(self.known.get(source, {"pages": 0, "cursor": None, "state": "open"}))
            while now["state"] == "open" and (at := pages.get(now["pages"])) and now["cursor"] in (None, at[0]):
                now = {"pages": now["pages"] + 1, "cursor": at[1], "state": "open" if at[1] else "exhausted"}
                if at[1] and not keepable(at[1], at[0]):
                    now |= {"cursor": None, "state": "refused"}
            self.known[source] = now
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [p for source, now in sorted(end.items()) for p in _runs(source, start.get(source, {"pages": 0})["pages"], now["pages"] - 1)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(LandedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages_of(items: DataFrame, size: int, href: Column, next_href: Column | None = None) -> DataFrame:
    """items (source, place: 0, 1, ... in a source, item: JSON text) as pages of that many; href and next_href from source,
    page and pages (how many the source has)."""
    n = items.groupBy("source").agg(F.ceil(F.count("*") / size).alias("pages"))
    put = items.withColumn("page", F.floor(F.col("place") / size)).groupBy("source", "page").agg(
        F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items")
    )
    put = put.join(n, "source").withColumn("href", href).withColumn("next_href", F.when(F.col("page") + 1 < F.col("pages"), next_href))
    links = F.when(F.col("next_href").isNull(), "").otherwise(F.concat(F.lit('{"rel":"next","href":"'), "next_href", F.lit('"}')))
    features = F.array_join(F.transform("items", lambda x: x["item"]), ",")
    value = F.concat(F.lit('{"type":"FeatureCollection","links":['), links, F.lit('],"features":['), features, F.lit("]}"))
    return put.select("source", "page", "href", "next_href", value.alias("value"))


def land(pages: DataFrame, path: str) -> None:
    """In order of pages, in row groups of a few MB, so that whoever reads a run of pages reads little else."""
    ordered = pages.sortWithinPartitions("source", "page")
    ordered.write.mode("append").partitionBy("source").option("compression", "zstd").option("parquet.block.size", BLOCK).parquet(path)


def checkpoint_for(path: str, request: str) -> str:
    """The checkpoint folder of one request's runs: another request begins with the first pages again."""
    return f"{path}/cursors-{request}"


def pull(spark, path: str, into: str, checkpoint: str) -> None:
    """Follow what has landed since the checkpoint, to its end."""
    register(spark)
    stream = spark.readStream.format("landed_pages").load(path)
    query = stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
