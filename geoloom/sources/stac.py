"""STAC items, as landed JSON text, to scenes; band names to assets; pages and their cursors; search bodies.

A row that breaks an invariant is dropped, never an error: `scenes` keeps the valid ones, and `schema.split_valid` of
`normalized` gives the others."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, from_point, intersects
from geoloom.functions.times import bucket, parsed, within_seconds
from geoloom.request import BBox, PullRequest
from geoloom.schema import valid_scene
from geoloom.tables import once

#: Bands by name: wavelength in micrometres, tolerance, common names.
BANDS = {"red": (0.665, 0.03, ("red",)), "green": (0.560, 0.03, ("green",)), "nir": (0.865, 0.05, ("nir", "nir08")), "swir22": (2.190, 0.15, ("swir22",))}
#: Starts of buckets whose region is part of their address.
REGIONS = {"deafrica-": "af-south-1"}
#: Ids of one lookup.
ID_BATCH = 50

_ITEM = "struct<bbox:array<double>,geometry:struct<type:string,coordinates:string>,assets:map<string,string>>"
_ASSET = """struct<href:string,type:string,title:string,roles:array<string>,alternate:struct<https:struct<href:string>>,
`eo:bands`:array<struct<center_wavelength:double,common_name:string>>>"""


def features(pages: DataFrame, value: str = "value") -> DataFrame:
    """page columns and item (JSON text) of every feature of FeatureCollection texts."""
    rest = [c for c in pages.columns if c != value]
    items = F.from_json(value, "struct<features:array<string>>")["features"]
    return pages.select(*rest, F.posexplode(items).alias("pos", "item"))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _is(v: Column, path: str, kind: str) -> Column:
    """Whether what stands at a path of a variant is of a kind."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind), F.lit(False))


def text_at(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """By its JSON text: a text has quotes and a boolean is a word, so neither is a number, nor is what isn't finite."""
    return _let(F.to_json(F.try_variant_get(v, path, "variant")), lambda t: F.when(t.rlike("^[-0-9]"), t.try_cast("double")))


def cloud_at(v: Column, path: str) -> Column:
    """A number, or one written as text, held to 0..100; null for what isn't finite."""
    x = F.coalesce(number_at(v, path), F.trim(text_at(v, path)).try_cast("double"))
    return _let(x, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))))


def https_href(href: Column, alternate: Column | None = None) -> Column:
    """An address that can be read without a store's own client: the https alternate, or the bucket's virtual host."""
    bucket, key = F.regexp_extract(href, r"^s3://([^/]+)/(.+)$", 1), F.regexp_extract(href, r"^s3://([^/]+)/(.+)$", 2)
    host = F.concat(bucket, F.lit(".s3.amazonaws.com/"))
    for start, region in REGIONS.items():
        host = F.when(bucket.startswith(start), F.concat(bucket, F.lit(f".s3.{region}.amazonaws.com/"))).otherwise(host)
    plain = F.when(bucket != "", F.concat(F.lit("https://"), host, key)).otherwise(href)
    if alternate is None:
        return plain
    return F.when(href.startswith("s3://") & alternate.startswith("https://"), alternate).otherwise(plain)


def _wrapped(lon: Column) -> Column:
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def _box(bbox: Column) -> Box:
    """Of four or six numbers; one of 360 degrees or more is the whole circle, edges beyond it are brought back."""
    half = (F.size(bbox) / 2).cast("int")
    ok = F.size(bbox).isin(4, 6)
    at = lambda i: F.when(ok, F.get(bbox, i if isinstance(i, Column) else F.lit(i)))
    west, east = at(0), at(half)
    whole = east - west >= 360
    return Box(F.when(whole, F.lit(-180.0)).otherwise(_wrapped(west)), at(1), F.when(whole, F.lit(180.0)).otherwise(_wrapped(east)), at(half + 1))


def _asset(a: Column, raw: Column) -> Column:
    """An asset from what its JSON text holds by name (a) and the text."""
    whole = lambda v: F.when(_is(v, "$['file:size']", "BIGINT"), F.try_variant_get(v, "$['file:size']", "bigint"))
    number = lambda v, name: number_at(v, f"$['raster:bands'][0].{name}")
    told = lambda v: F.struct(number(v, "scale").alias("scale"), number(v, "offset").alias("offset"), whole(v).alias("size"))
    return _let(
        _let(F.try_parse_json(raw), told),
        lambda t: F.struct(
            https_href(a["href"], a["alternate"]["https"]["href"]).alias("href"),
            a["type"].alias("media_type"),
            a["title"].alias("title"),
            F.coalesce(a["roles"], F.array().cast("array<string>")).alias("roles"),
            t["scale"].alias("scale"),
            t["offset"].alias("offset"),
            F.when(t["size"] >= 0, t["size"]).alias("size_bytes"),
        ),
    )


def band_aliases(assets: Column) -> Column:
    """Map of band to asset key, from entries (key, a: what the asset holds): single-band assets alone; the nearest wavelength
    within tolerance, by key among equals; else, among assets without a wavelength, the least key of a known name."""
    single = F.filter(assets, lambda x: F.size(x["a"]["eo:bands"]) == 1)

    def one(x: Column) -> Column:
        band = x["a"]["eo:bands"][0]
        w = band["center_wavelength"]
        return F.struct(
            x["key"].alias("key"), F.when((w > 0) & (w < float("inf")), w).alias("w"), F.nullif(F.lower(F.trim(band["common_name"])), F.lit("")).alias("n")
        )

    def pick(told: Column, band: str) -> Column:
        target, tolerance, names = BANDS[band]
        near = F.filter(told, lambda x: F.abs(x["w"] - target) <= tolerance)
        by_wave = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["w"] - target).alias("d"), x["key"].alias("key"))))["key"]
        by_name = F.array_min(F.transform(F.filter(told, lambda x: x["w"].isNull() & x["n"].isin(*names)), lambda x: x["key"]))
        return F.coalesce(by_wave, by_name)

    entries = _let(F.transform(single, one), lambda told: F.array(*[F.struct(F.lit(b).alias("key"), pick(told, b).alias("value")) for b in BANDS]))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def overlaid(aliases: Column, fixed: dict[str, str]) -> Column:
    """Aliases with some of a source's own in their place."""
    own = F.map_from_arrays(F.array(*map(F.lit, fixed)), F.array(*map(F.lit, fixed.values())))
    kept = F.map_filter(aliases, lambda k, _: ~k.isin(*fixed))
    return F.map_concat(kept, own)


def normalized(items: DataFrame, source: str = "", collection: str = "", kind: str = "optical", gsd_m: float | None = None, platform: str = "unknown") -> DataFrame:
    """A row of `schema.SCENES` for every item (JSON text), valid or not.

    An item is parsed once. What a row is judged and chosen by is worked out once; the rest is worked out for rows that are
    left, and not at all where nobody asks for it."""
    v, i, at = F.col("_v"), F.col("_i"), F.col("_at")
    rows = items.select("ord", F.try_parse_json("item").alias("_v"), F.from_json("item", _ITEM).alias("_i"))
    point = i["geometry"]["type"] == "Point"
    rows = rows.withColumn("_at", F.when(point, F.from_json(i["geometry"]["coordinates"], "array<double>")))
    given = _box(i["bbox"])
    has = given.west.isNotNull() & given.south.isNotNull() & given.east.isNotNull() & given.north.isNotNull()
    lon, lat = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    padded = from_point(lon, lat)
    box = [F.when(has, g).when(lon.isNotNull() & lat.isNotNull(), p) for g, p in zip(given, padded, strict=True)]
    shape = F.when(point & lon.isNotNull() & lat.isNotNull(), "point").when(i["geometry"]["type"].isin("Polygon", "MultiPolygon"), "polygon").otherwise("bbox")
    when = F.coalesce(text_at(v, "$.properties.datetime"), text_at(v, "$.properties.start_datetime"))
    name = F.coalesce(*[F.coalesce(F.nullif(text_at(v, p), F.lit("")), text_at(v, p + "[0]")) for p in ("$.properties['const:platform']", "$.properties.platform")], F.lit(platform))
    rows = once(
        rows,
        "ord",
        "_v",
        "_i",
        text_at(v, "$.id").alias("id"),
        parsed(when).alias("ts"),
        parsed(text_at(v, "$.properties.start_datetime")).alias("start_ts"),
        parsed(text_at(v, "$.properties.end_datetime")).alias("end_ts"),
        *[b.alias(n) for b, n in zip(box, Box._fields, strict=True)],
        shape.alias("geometry_kind"),
        lon.alias("lon"),
        lat.alias("lat"),
        F.coalesce(number_at(v, "$.properties.gsd"), F.lit(gsd_m).cast("double")).alias("gsd_m"),
        cloud_at(v, "$.properties['eo:cloud_cover']").alias("cloud"),
        keep=3,
    )
    entry = lambda k, raw: F.struct(k.alias("key"), raw.alias("raw"), F.from_json(raw, _ASSET).alias("a"))
    held = F.transform(F.map_entries(i["assets"]), lambda e: entry(e["key"], e["value"]))
    kept = F.filter(F.coalesce(held, F.filter(F.array(entry(F.lit(""), F.lit(""))), lambda e: F.lit(False))), lambda e: e["a"]["href"].isNotNull())
    return rows.withColumn("_kept", kept).select(
        "ord",
        "id",
        F.lit(source).alias("source"),
        F.lit(collection).alias("collection"),
        F.lit(kind).alias("kind"),
        "ts",
        "start_ts",
        "end_ts",
        *Box._fields,
        "geometry_kind",
        "lon",
        "lat",
        "gsd_m",
        name.alias("platform"),
        text_at(v, "$.properties.instruments[0]").alias("instrument"),
        "cloud",
        F.lit(False).alias("footprint_is_request"),
        F.transform("_kept", lambda e: F.struct(e["key"].alias("key"), _asset(e["a"], e["raw"]).alias("asset"))).alias("assets"),
        band_aliases(F.col("_kept")).alias("band_aliases"),
        F.try_variant_get(v, "$.properties", "map<string,string>").alias("properties"),
    )


def scenes(items: DataFrame, **source) -> DataFrame:
    """The valid scenes of items (ord, item)."""
    return normalized(items, **source).filter(valid_scene())


def stamped(rows: DataFrame, source: str, collection: str) -> DataFrame:
    """source and collection filled in where they are empty."""
    fill = lambda c, x: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(x)).otherwise(F.col(c)).alias(c)
    given = {"source": source, "collection": collection}
    return rows.select(*[fill(c, given[c]) if c in given else F.col(f"`{c}`") for c in rows.columns])


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The scenes whose id is asked for."""
    return items.join(ids.select("id").distinct(), "id", "left_semi")


def id_batches(ids: list[str], size: int = ID_BATCH) -> list[list[str]]:
    once = list(dict.fromkeys(ids))
    return [once[i : i + size] for i in range(0, len(once), size)]


#: Seconds about a stored scene's time, and scenes of one answer.
PLACE_TIME_SECONDS, PLACE_TIME_LIMIT = 60, 20


def place_time_body(collection: str, when: dt.datetime, footprint: BBox, sends_dates: bool = True) -> dict:
    """The body of a search for what a catalog has about one stored scene."""
    body: dict = {"collections": [collection], "bbox": list(footprint.edges), "limit": PLACE_TIME_LIMIT}
    if sends_dates:
        about = dt.timedelta(seconds=PLACE_TIME_SECONDS)
        body["datetime"] = "/".join(t.strftime("%Y-%m-%dT%H:%M:%SZ") for t in (when - about, when + about))
    return body


def place_time_hits(stored: DataFrame, catalog: DataFrame, seconds: int = PLACE_TIME_SECONDS, limit: int = PLACE_TIME_LIMIT) -> DataFrame:
    """old_id and the columns of what a catalog has about each stored scene: of its collection, within the seconds, meeting
    its footprint; the first `limit` by time and id, one answer's worth.

    Both: id, collection, ts, edges. An equal join on collection and a bucket of time, in which a stored scene stands three
    times, then the exact tests."""
    old = stored.select(
        F.col("id").alias("old_id"), "collection", F.col("ts").alias("_ts"), F.struct("west", "south", "east", "north").alias("_box"),
        F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: bucket(F.col("ts"), seconds) + k)).alias("_bucket"),
    )
    met = old.join(catalog.withColumn("_bucket", bucket(F.col("ts"), seconds)), ["collection", "_bucket"])
    met = met.filter(within_seconds(F.col("_ts"), F.col("ts"), seconds) & intersects(Box.col("_box"), Box.col()))
    nth = F.row_number().over(W.partitionBy("old_id").orderBy("ts", "id"))
    return met.withColumn("_nth", nth).filter(F.col("_nth") <= limit).select("old_id", *catalog.columns)


def search_body(request: PullRequest, collection: str, kind: str, limit: int, sends_dates: bool = True, platform: str | None = None) -> dict:
    """The body of a search: either the ring or the box, whole days, cloud bounds where they mean something."""
    body: dict = {"collections": [collection], "limit": limit}
    if request.polygon is not None:
        body["intersects"] = {"type": "Polygon", "coordinates": [[list(p) for p in request.polygon.ring]]}
    else:
        body["bbox"] = list(request.bbox.edges)
    if sends_dates:
        body["datetime"] = f"{request.start}T00:00:00Z/{request.end}T23:59:59Z"
    query: dict = {}
    if kind in ("optical", "browse"):
        bounds = {k: x for k, x in (("gte", request.min_cloud), ("lte", request.max_cloud)) if x is not None}
        query |= {"eo:cloud_cover": bounds} if bounds else {}
    if platform:
        query["platform"] = {"eq": platform}
    return body | ({"query": query} if query else {})


def next_cursor(pages: DataFrame) -> DataFrame:
    """page columns and cursor: the canonical JSON of a page's next link (method, href, body, merge), null if none."""
    links = F.from_json("value", "struct<links:array<struct<rel:string,method:string,href:string,body:string,merge:boolean>>>")["links"]
    found = F.get(F.filter(links, lambda x: x["rel"] == "next"), F.lit(0))
    cursor = F.to_json(F.struct(found["body"].alias("body"), found["href"].alias("href"), F.coalesce(found["merge"], F.lit(False)).alias("merge"), F.coalesce(found["method"], F.lit("GET")).alias("method")))
    return pages.select(*[c for c in pages.columns if c != "value"], F.when(found["href"].isNotNull(), cursor).alias("cursor"))


def replayed(cursor: str, first_body: dict) -> tuple[str, str, dict | None]:
    """(method, href, body) of the request that a cursor stands for; a merging link changes the first body, and a ring
    in either wins over a box."""
    c = json.loads(cursor)
    body = json.loads(c["body"]) if c.get("body") else None
    if c.get("merge"):
        body = first_body | (body or {})
        if "intersects" in body:
            body.pop("bbox", None)
    return c["method"], c["href"], body
