"""What a source answers a request with, from payloads that have landed: one call for all 61 sources.

    Source.of("sentinel2").search(items, request)

A source is a row of the registry; its family says what its payloads are and how they are read, and OVERRIDES what is its
own besides. A search gives the columns of `schema.SCENES` that its family knows, within the request's area, days and cloud
bounds, as many as its limit."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, intersects
from geoloom.functions.times import within_days
from geoloom.operators.scenes import cloud_within
from geoloom.request import PullRequest
from geoloom.sources import listings, payloads, registry, stac, trees

#: Sources that share a collection and take one platform of it; bands that are named by a source itself, the
#: first of the assets that an item has.
OVERRIDES: dict[str, dict] = {
    "landsat8": {"platform": "landsat-8"},
    "landsat9": {"platform": "landsat-9"},
    "goes_cmi": {"bands": {"red": ["C02_2km_wm", "C02_2km"], "nir": ["C03_2km_wm", "C03_2km"], "blue": ["C01_2km_wm", "C01_2km"]}},
    "cdse_sentinel3_olci": {"bands": {"red": ["Oa08_radianceData"], "green": ["Oa06_radianceData"], "nir": ["Oa17_radianceData"]}},
}


@dataclass(frozen=True)
class Source:
    """payloads of a search, by family: stac, cmr, grid: ord, item (JSON text); firms: area, last, line_no, line; goes:
    bucket, key; himawari: key; gibs: none (a session's DataFrame of any kind); tree: the nodes that `trees` walks."""

    name: str
    family: str
    collection: str | None
    satellite: str
    kind: str
    gsd_m: float | None
    own: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str) -> Source:
        for key, family, _, collection, satellite, kind, gsd, _ in registry.rows():
            if key == name:
                return cls(key, family, collection, satellite, kind, gsd, OVERRIDES.get(key, {}))
        raise KeyError(name)

    def search(self, landed: DataFrame, request: PullRequest, now: dt.datetime | None = None) -> DataFrame:
        """now: needed by listings and feeds, whose newest files are not all there yet."""
        if self.family in ("goes", "himawari", "listing", "firms") and now is None:
            raise ValueError(f"{self.name} has to know what time it is")
        if self.family == "stac":
            return self._limited(self._stac(landed), request)
        if self.family == "cmr":
            return self._limited(payloads.granules(landed, self.name, self.collection, self.kind, self.gsd_m), request)
        if self.family == "grid":
            return self._limited(payloads.model_granules(landed, self.collection, request), request)
        if self.family == "firms":
            return listings.fire_search(landed, request, self.collection, now.date(), gsd_m=self.gsd_m)
        if self.family == "listing":
            return (listings.goes_search if self.name == "goes" else listings.himawari_search)(landed, request, now)
        if self.family == "gibs":
            return payloads.previews(landed.sparkSession, request, self.collection)
        if self.family == "tree":
            return self._limited(self._tree(landed, request), request)
        raise ValueError(f"{self.name}: no family {self.family}")

    def _tree(self, nodes: DataFrame, request: PullRequest) -> DataFrame:
        """Items by the walk of their catalogs; an item's collection is the catalog it hangs on."""
        found = trees.items(nodes, request)
        return found.select(
            F.xxhash64("id").alias("ord"), "id", F.lit(self.name).alias("source"), F.coalesce(F.lit(self.collection), "parent").alias("collection"), F.lit(self.kind).alias("kind"),
            F.col("first").cast("timestamp").alias("ts"), *Box._fields, F.lit("bbox").alias("geometry_kind"), F.lit(self.gsd_m).cast("double").alias("gsd_m"), F.lit(None).cast("double").alias("cloud"),
        )

    def _stac(self, items: DataFrame) -> DataFrame:
        found = stac.scenes(items, source=self.name, collection=self.collection, kind=self.kind, gsd_m=self.gsd_m, platform=self.collection)
        if "platform" in self.own:
            found = found.filter(F.col("platform") == self.own["platform"])
        if "bands" in self.own:
            names = F.transform("assets", lambda a: a["key"])
            first = lambda keys: F.get(F.filter(F.array(*map(F.lit, keys)), lambda k: F.array_contains(names, k)), F.lit(0))
            pins = F.array(*[F.struct(F.lit(band).alias("key"), first(keys).alias("value")) for band, keys in self.own["bands"].items()])
            pinned = F.filter(pins, lambda p: p["value"].isNotNull())
            kept = F.map_filter("band_aliases", lambda band, _: ~F.array_contains(F.transform(pinned, lambda p: p["key"]), band))
            found = found.withColumn("band_aliases", F.map_concat(kept, F.map_from_entries(pinned)))
        return found

    def _limited(self, scenes: DataFrame, request: PullRequest) -> DataFrame:
        """What a catalog's own search would have left out, and the first of each id; the limit is the first page's."""
        near = intersects(Box.col(), Box.of(*request.bbox.edges)) & within_days(F.col("ts").cast("timestamp_ntz"), request.start, request.end)
        kept = scenes.filter(near & cloud_within(request.min_cloud, request.max_cloud))
        first = kept.groupBy("id").agg(F.min_by(F.struct(*kept.columns), "ord").alias("s")).select("s.*")
        return first if request.limit is None else first.orderBy("ord").limit(request.limit)
