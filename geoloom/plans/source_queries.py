"""Queries of the sources: payloads made of the test tables, read back as scenes; each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from geoloom.functions.geo import Box, intersects
from geoloom.operators import manifest, pull
from geoloom.plans.scene_queries import DATELINE, MEETS_DATELINE
from geoloom.plans.views import oracle, view
from geoloom.request import BBox, PullRequest
from geoloom.sources import listings, registry, stac
from geoloom.sources import payloads as P
from geoloom.sources.families import Source
from geoloom.tables import join_checked, read


def _items(spark, sf_dir):
    """STAC items of the scenes view, with all that a catalog gets wrong: text for numbers, boxes of six, points alone,
    missing times."""
    s = view(spark, sf_dir, "scenes")
    n = F.col("ord")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    num = lambda c: F.col(c).cast("bigint").cast("string")
    turn = F.when(F.col("east") < F.col("west"), F.col("east") + 360).otherwise(F.col("east")).cast("bigint").cast("string")
    box4 = F.concat_ws(",", num("west"), num("south"), num("east"), num("north"))
    box6 = F.concat_ws(",", num("west"), num("south"), F.lit("0"), turn, num("north"), F.lit("9"))
    box = F.when(n % 23 == 0, F.lit("")).when(n % 7 == 0, F.concat(F.lit(',"bbox":['), box6, F.lit("]"))).otherwise(F.concat(F.lit(',"bbox":['), box4, F.lit("]")))
    shape = F.when(n % 23 == 0, F.concat(F.lit('{"type":"Point","coordinates":['), num("lon"), F.lit(","), num("lat"), F.lit("]}"))).otherwise(F.lit('{"type":"Polygon","coordinates":[]}'))
    cloud = F.when(F.col("cloud").isNull(), F.lit("null")).when(n % 2 == 0, quote(num("cloud"))).when(n % 5 == 0, F.lit("true")).otherwise(F.concat(num("cloud"), F.lit(".0")))
    when = F.when(n % 31 == 0, F.lit('"never"')).otherwise(quote(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    gsd = F.when(n % 3 == 0, F.lit("10")).when(n % 3 == 1, F.lit('"20"')).otherwise(F.lit("null"))
    name = F.when(n % 4 == 0, F.lit('"platform":"P1",')).when(n % 4 == 1, F.lit('"platform":["P2","x"],')).otherwise(F.lit(""))
    asset = F.concat(
        F.lit('{"B04":{"href":"s3://bucket/a/'), n.cast("string"), F.lit('.tif","type":"image/tiff","roles":["data"],"file:size":'),
        F.when(n % 2 == 0, n.cast("string")).otherwise(F.lit('"7"')),
        F.lit(',"eo:bands":[{"center_wavelength":0.66,"common_name":"red"}],"raster:bands":[{"scale":0.0001,"offset":-0.1}]},"near":{"href":"https://e.x/n","eo:bands":[{"common_name":" NIR08 "}]},'
              '"visual":{"href":"https://e.x/v","eo:bands":[{"common_name":"red"},{"common_name":"green"}]},"bad":{"title":"no href"}}'),
    )
    item = F.concat(
        F.lit('{"type":"Feature","id":'), F.when(n % 37 == 0, F.lit("12")).otherwise(quote(F.concat(F.lit("I"), n.cast("string")))), box, F.lit(',"geometry":'), shape,
        F.lit(',"properties":{'), name, F.lit('"datetime":'), when, F.lit(',"eo:cloud_cover":'), cloud, F.lit(',"gsd":'), gsd, F.lit(',"instruments":["msi"]},"assets":'), asset, F.lit("}"),
    )
    return s.select("ord", item.alias("item"))


def n01_stac_items(spark, sf_dir):
    s = stac.scenes(_items(spark, sf_dir), source="sentinel2", collection="sentinel-2-l2a", gsd_m=30.0)
    return s.select("ord", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "west", "south", "east", "north", "geometry_kind", "lon", "lat", "gsd_m", "platform", "instrument", "cloud")


def n01f_stac_assets(spark, sf_dir):
    s = stac.scenes(_items(spark, sf_dir))
    return s.select("ord", F.explode("assets").alias("a")).select("ord", "a.key", "a.asset.href", "a.asset.media_type", "a.asset.scale", "a.asset.offset", "a.asset.size_bytes", F.size("a.asset.roles").alias("n_roles"))


def n11_band_aliases(spark, sf_dir):
    s = stac.scenes(_items(spark, sf_dir))
    return s.select("ord", F.explode("band_aliases").alias("band", "key"))


def n12_alias_overrides(spark, sf_dir):
    s = stac.scenes(_items(spark, sf_dir)).withColumn("band_aliases", stac.overlaid(F.col("band_aliases"), {"red": "C02_2km", "blue": "C01_2km"}))
    return s.select("ord", F.explode("band_aliases").alias("band", "key"))


def src02_stac_pages(spark, sf_dir):
    """Items wrapped into pages of a search, and unwrapped."""
    pages = _items(spark, sf_dir).withColumn("page", F.floor(F.col("ord") / 50)).groupBy("page").agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), ","), F.lit("]}")).alias("value")
    )
    items = stac.features(pages).select((F.col("page") * 50 + F.col("pos")).alias("ord"), "item", "page")
    return stac.scenes(items.drop("page")).select("id", "cloud", "platform")


def src04_place_time(spark, sf_dir):
    """Every candidate of a collection within a minute that meets a stored scene, 20 at most."""
    cols = ("id", "collection", "ts", "west", "south", "east", "north")
    return stac.place_time_hits(view(spark, sf_dir, "stored"), view(spark, sf_dir, "candidates").select(*cols)).select("old_id", "id")


def src13_model_granules(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").filter("west <= east")
    n = F.col("ord").cast("string")
    link = lambda i: F.concat(F.lit('{"URL":"https://x/'), n, F.lit(f'.{i}","Type":'), F.lit('"GET DATA"}' if i == "nc" else '"USE SERVICE API","Subtype":"OPENDAP DATA"}'))
    urls = F.when(F.col("ord") % 4 == 0, link("nc")).otherwise(F.concat(link("nc"), F.lit(","), link("dap")))
    item = F.concat(
        F.lit('{"meta":{"concept-id":"G'), n, F.lit('"},"umm":{"TemporalExtent":{"SingleDateTime":"2024-01-01T00:00:00Z"},"SpatialExtent":{"HorizontalSpatialDomain":{"Geometry":{"BoundingRectangles":[{"WestBoundingCoordinate":1,"SouthBoundingCoordinate":2,"EastBoundingCoordinate":3,"NorthBoundingCoordinate":4}]}}},"RelatedUrls":['),
        urls, F.lit("]}}"),
    )
    r = PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 31), BBox(0.0, 0.0, 10.0, 10.0))
    return P.model_granules(s.select("ord", item.alias("item")), "FLDAS_NOAH01_C_GL_M", r).select("ord", "id", "data_href")


def _manifests(spark, sf_dir):
    """A manifest of each supplier's part of the orders' scenes: some rows of an older format, some without a name, some
    files cut off."""
    s = view(spark, sf_dir, "scenes").withColumn("file", F.col("ord") % 300)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rich = F.concat(F.lit('{"id":'), q("id"), F.lit(',"collection":'), q("collection"), F.lit(',"datetime":'), q(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit(',"footprint":['), F.concat_ws(",", *[F.col(c).cast("bigint").cast("string") for c in ("west", "south", "east", "north")]), F.lit("]}"))
    g = s.groupBy("file", "source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord") % 2 == 0, F.struct("ord", rich.alias("r"))))), lambda x: x["r"]), ",").alias("rich"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", q("id").alias("r")))), lambda x: x["r"]), ",").alias("bare"),
    )
    name = F.when(F.col("source") == "src6", F.lit("7")).otherwise(q("source"))
    own = F.when(F.col("file") % 2 == 0, F.lit(',"request":{"own":1}')).otherwise("")
    row = F.concat(F.lit('{"source":'), name, own, F.lit(',"scenes":['), "rich", F.lit('],"scene_ids":['), "bare", F.lit("]}"))
    files = g.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("rows"))
    return files.select("file", F.concat(F.lit('{"request":{"top":1},"sources":['), "rows", F.when(F.col("file") % 7 == 0, F.lit("]")).otherwise(F.lit("]}"))).alias("text"))


def src20_manifest_rows(spark, sf_dir):
    return manifest.source_rows(_manifests(spark, sf_dir)).groupBy("source", "request").agg(F.count("*").alias("n"))


def u06_stored_scenes(spark, sf_dir):
    rows = manifest.source_rows(_manifests(spark, sf_dir).filter("file = 2 OR file = 3"))
    return manifest.stored_scenes(rows.withColumn("source", F.concat("source", F.lit("-"), F.col("request")))).select("source", "id", "collection", F.col("ts").cast("timestamp_ntz").alias("ts"), "west")


def src01_one_call(spark, sf_dir):
    """A source by its name: items to scenes, within area, days and cloud bounds."""
    r = PullRequest(dt.date(1995, 1, 1), dt.date(1995, 12, 31), DATELINE, max_cloud=50)
    return Source.of("sentinel2").search(_items(spark, sf_dir), r).select("id", "source", "collection", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"))


def src03_by_ids(spark, sf_dir):
    s = view(spark, sf_dir, "scenes")
    return stac.by_ids(s, spark.range(0, 997, 10).select(F.concat(F.lit("S"), "id").alias("id"))).select("ord", "id")


def src05_next_cursor(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    value = F.when(F.col("page_id") % 3 == 0, F.lit('{"links":[{"rel":"self","href":"https://a/1"}]}')).otherwise(
        F.concat(F.lit('{"links":[{"rel":"self","href":"https://a/1"},{"rel":"next","method":"POST","href":"https://a/s","merge":true,"body":{"token":"t'), F.col("page_id").cast("string"), F.lit('"}}]}'))
    )
    c = stac.next_cursor(p.select("page_id", value.alias("value")))
    return c.select("page_id", F.get_json_object("cursor", "$.href").alias("href"), F.get_json_object("cursor", "$.merge").alias("merge"), F.get_json_object(F.get_json_object("cursor", "$.body"), "$.token").alias("token"))


def n07_stamped(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").select("ord", F.when(F.col("ord") % 2 == 0, F.col("source")).alias("source"), F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.col("collection")).alias("collection"))
    return stac.stamped(s, "asked", "c-asked")


def n02_granules(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").filter("west <= east")
    n = F.col("ord")
    num = lambda c: F.col(c).cast("bigint").cast("string")
    rect = F.concat(F.lit('"BoundingRectangles":[{"WestBoundingCoordinate":'), num("west"), F.lit(',"SouthBoundingCoordinate":'), num("south"), F.lit(',"EastBoundingCoordinate":'), num("east"), F.lit(',"NorthBoundingCoordinate":'), num("north"), F.lit("}]"))
    point = lambda a, b: F.concat(F.lit('{"Longitude":'), num(a), F.lit(',"Latitude":'), num(b), F.lit("}"))
    poly = F.concat(F.lit('"GPolygons":[{"Boundary":{"Points":['), F.concat_ws(",", point("west", "south"), point("east", "south"), point("east", "north")), F.lit("]}}]"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(n % 5 == 0, F.concat(F.lit('"SingleDateTime":"'), stamp, F.lit('"'))).otherwise(F.concat(F.lit('"RangeDateTime":{"BeginningDateTime":"'), stamp, F.lit('"}')))
    item = F.concat(
        F.lit('{"meta":{"concept-id":"G'), n.cast("string"), F.lit('"},"umm":{"TemporalExtent":{'), time, F.lit('},"SpatialExtent":{"HorizontalSpatialDomain":{"Geometry":{'),
        F.when(n % 3 == 0, poly).otherwise(rect), F.lit('}}},"CloudCover":'), F.coalesce(num("cloud"), F.lit("null")),
        F.lit(',"RelatedUrls":[{"URL":"ftp://x/y","Type":"GET DATA"},{"URL":"https://x/'), n.cast("string"), F.lit('.hdf","Type":"GET DATA"}]}}'),
    )
    g = P.granules(s.select("ord", item.alias("item")), "modis_surface", "MOD09GA", "optical", 500.0)
    return g.select("ord", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "west", "south", "east", "north", "geometry_kind", "cloud", "data_href", "platform")


def _fires(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    hour = F.date_format("ts", "HHmm").cast("int").cast("string")
    line = F.concat_ws(",", F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon"), F.lit("300.1,0.4,0.4"), F.date_format("ts", "yyyy-MM-dd"), hour, F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit("N")), F.lit("VIIRS,n,2.0NRT,290.0"), F.col("frp_cents").cast("string"), F.lit("D"))
    return P.fires(d.select("ord", F.when(F.col("event_id") % 17 == 0, F.lit("Invalid request")).otherwise(line).alias("line")), "VIIRS_SNPP_NRT", "Suomi NPP")


def n03_fire_lines(spark, sf_dir):
    return _fires(spark, sf_dir).select("ord", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("west", 6).alias("west"), F.round("north", 6).alias("north"), "platform", "frp")


def snk03_detections_table(spark, sf_dir):
    return P.detections_table(_fires(spark, sf_dir).select("id", "ts", "lat", "lon", "platform", "confidence")).select("id", "time", "platform", "confidence")


def n04_goes_keys(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    name = F.concat(F.lit("ABI-L2-MCMIPC/2024/001/00/OR_ABI-L2-MCMIPC-M6_G16_s"), F.date_format("ts", "yyyyDDDHHmmss"), F.lit("0_e0_c"), F.col("event_id").cast("string"), F.lit(".nc"))
    keys = d.select("ord", F.when(F.col("event_id") % 9 == 0, F.lit("readme.txt")).otherwise(name).alias("key"))
    return P.goes(keys, "noaa-goes16", "east", "ABI-L2-MCMIPC").select("ord", F.col("ts").cast("timestamp_ntz").alias("ts"), "platform", F.length("href").alias("n"))


def n05_himawari_slots(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    band = lambda i: F.concat(F.lit("HS_H09_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.date_format("ts", "HH"), F.lit(f"00_B0{i}_FLDK_R20_S0"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("10.DAT.bz2"))
    keys = d.select(F.explode(F.array(*[band(i) for i in (1, 3)])).alias("key"))
    return P.himawari(keys).select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("assets").alias("n"))


def src08_day_previews(spark, sf_dir):
    """Of each day's previews, on either side of 180 degrees, the scenes that they show something of."""
    r = PullRequest(dt.date(1995, 1, 1), dt.date(1997, 12, 31), DATELINE, limit=700)
    shown = P.previews(spark, r, "MODIS_Terra").select("id", F.col("ts").cast("date").alias("day"), Box.col().struct().alias("shown"), "width", "height")
    scenes = view(spark, sf_dir, "scenes").select("ord", *Box._fields, F.col("ts").cast("date").alias("day"))
    met = join_checked(scenes, shown, ["day"]).filter(intersects(Box.col("shown"), Box.col()))
    return met.groupBy("id", "day", "width", "height").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def src11_listing_pages(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    entry = F.concat(F.lit("<Contents><Key>a/"), F.col("p_partkey").cast("string"), F.lit("</Key></Contents>"))
    pages = p.withColumn("page", F.col("p_partkey") % 40).groupBy("page").agg(
        F.concat(F.lit('<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">'), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.when(F.col("page") % 10 != 9, F.lit("<CommonPrefixes><Prefix>d/</Prefix></CommonPrefixes></ListBucketResult>")).otherwise(F.lit("<Contents>"))).alias("value")
    )
    return P.s3_listing(pages).select("page", F.size("keys").alias("n_keys"), F.size("prefixes").alias("n_prefixes"))


def src12_catalog_tree(spark, sf_dir):
    s = view(spark, sf_dir, "scenes").filter("west <= east")
    own = s.select(F.col("ord").alias("id"), (F.col("ord") % 300).alias("parent"), "ts", "west", "south", "east", "north")
    acq = own.groupBy(F.col("parent").alias("id")).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"), F.min(F.col("ts").cast("date")).alias("first"), F.max(F.col("ts").cast("date")).alias("last")).withColumn("parent", F.col("id") % 60)
    ev = acq.groupBy(F.col("parent").alias("id")).agg(*[f(c).alias(c) for c, f in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max), ("first", F.min), ("last", F.max))])
    ev = ev.withColumn("west", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("west")))
    r = PullRequest(dt.date(1995, 1, 1), dt.date(1995, 12, 31), DATELINE)
    return P.tree_items(ev, acq, own, r).select("id")


#: Nodes of each level above the items.
_WIDE = (4, 20, 100, 500, 2500)


def _nodes(spark, sf_dir):
    """A tree of six levels: scenes by the remainder of their number, up to the top. The extent of a catalog with a scene
    across 180 degrees is not known."""
    s = view(spark, sf_dir, "scenes").withColumn("day", F.col("ts").cast("date"))
    name = lambda k: F.concat(F.lit(f"L{k}-"), (F.col("ord") % _WIDE[k]).cast("string"))
    edge = lambda f, c: F.when(F.max(F.col("west") > F.col("east")), None).otherwise(f(c)).alias(c)
    nodes = s.select(F.concat(F.lit("I-"), F.col("ord").cast("string")).alias("id"), name(4).alias("parent"), F.lit(True).alias("leaf"), "west", "south", "east", "north", F.col("day").alias("first"), F.col("day").alias("last"))
    for k in range(5):
        above = name(k - 1) if k else F.lit(None).cast("string")
        extent = [edge(F.min, "west"), edge(F.min, "south"), edge(F.max, "east"), edge(F.max, "north"), F.min("day").alias("first"), F.max("day").alias("last")]
        nodes = nodes.unionByName(s.groupBy(name(k).alias("id"), above.alias("parent"), F.lit(False).alias("leaf")).agg(*extent))
    return nodes


def src12_deep_tree(spark, sf_dir):
    return Source.of("maxar_opendata").search(_nodes(spark, sf_dir), PullRequest(dt.date(1995, 1, 1), dt.date(1995, 12, 31), DATELINE)).select("id", "collection", "kind", "west", "east")


def _deep_sql() -> str:
    parts = ["SELECT 'I-' || ord AS id, 'L4-' || ord % 2500 AS parent, TRUE AS leaf, west, south, east, north, CAST(ts AS DATE) AS first, CAST(ts AS DATE) AS last FROM scenes"]
    for k, n in enumerate(_WIDE):
        above = f"'L{k - 1}-' || ord % {_WIDE[k - 1]}" if k else "CAST(NULL AS VARCHAR)"
        edges = ", ".join(f"CASE WHEN NOT bool_or(west > east) THEN {f}({c}) END AS {c}" for f, c in (("min", "west"), ("min", "south"), ("max", "east"), ("max", "north")))
        parts.append(f"SELECT 'L{k}-' || ord % {n}, {above}, FALSE, {edges}, min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) FROM scenes GROUP BY 1, 2")
    return f""", nodes AS ({" UNION ALL ".join(parts)}),
asked AS MATERIALIZED (SELECT * FROM nodes WHERE (west IS NULL OR {MEETS_DATELINE}) AND first <= DATE '1995-12-31' AND last >= DATE '1995-01-01'),
walk AS (SELECT * FROM asked WHERE parent IS NULL UNION ALL SELECT a.* FROM asked a JOIN walk w ON a.parent = w.id AND NOT w.leaf)
SELECT id, parent AS collection, 'optical' AS kind, west, east FROM walk WHERE leaf"""


def src21_registry(spark, sf_dir):
    """Scenes dealt to the sources of the registry: how many each kind and family would have to read."""
    known = registry.sources(spark).select("source", "family", "kind")
    place = {r[0]: i for i, r in enumerate(registry.rows())}
    numbered = known.withColumn("place", F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("source")])
    s = view(spark, sf_dir, "scenes").select(F.pmod("ord", F.lit(len(place))).cast("int").alias("place"), "ts")
    return join_checked(s, numbered, ["place"]).groupBy("family", F.col("kind")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.max("ts").alias("newest"))


def t01_search_and_estimate(spark, sf_dir):
    """Three optical sources in one call, of which one has nothing landed; a quarter of what is found is there."""
    landed = {"sentinel2": _items(spark, sf_dir), "hls_sentinel": _items(spark, sf_dir).filter("ord % 3 = 0")}
    r = PullRequest(dt.date(1995, 1, 1), dt.date(1995, 12, 31), DATELINE, max_cloud=50)
    scenes, errors = pull.search(landed, r, "optical", ["sentinel2", "hls_sentinel", "naip"])
    present = view(spark, sf_dir, "scenes").filter("ord % 4 = 0").select(F.lit("sentinel2").alias("source"), F.concat(F.lit("I"), F.col("ord").cast("string")).alias("scene"))
    return pull.estimated(scenes, errors, present).select("source", "error", "n_scenes", "cloud", "scene_count", "known_bytes", "unknown_scenes", "already_present")


def _grid_files(spark, sf_dir):
    """An answer of 6 by 5 cells for every 30 orders: every second one a gateway's, every third one with a note behind it."""
    cells = view(spark, sf_dir, "numbered").select(
        F.floor(F.col("n") / 30).alias("file"), (F.col("n") % 30).cast("int").alias("i"), F.when(F.col("n") % 13 == 0, -9999.0).otherwise(F.col("n") * 1.5).alias("v")
    )
    line = lambda y: F.array_join(F.transform(F.filter("c", lambda x: F.floor(x["i"] / 6) == y), lambda x: x["v"].cast("string")), ", ")
    full = cells.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).filter(F.size("c") == 30)
    classic = [F.lit("Dataset {"), F.lit("} x;"), F.lit("Evap_tavg.Evap_tavg[1][5][6]"), *[F.concat(F.lit(f"[0][{y}], "), line(y)) for y in range(5)], F.lit(""), F.lit("X.X[6]"), F.lit("0, 1, 2, 3, 4, 5")]
    gateway = [F.lit("Dataset: x.nc"), F.lit("Evap_tavg.X, 0, 1, 2, 3, 4, 5"), *[F.concat(F.lit(f"Evap_tavg.Evap_tavg[Evap_tavg.Y={y}], "), line(y)) for y in range(5)]]
    note = F.when(F.col("file") % 3 == 0, F.lit('Note.Note[1]\n"7, 8"'))
    return full.select(F.concat(F.lit("m"), F.col("file").cast("string")).alias("file"), F.when(F.col("file") % 2 == 0, F.concat_ws("\n", *classic, note)).otherwise(F.concat_ws("\n", *gateway)).alias("text"))


def src14_grid_text(spark, sf_dir):
    return P.grid_cells(P.grids(_grid_files(spark, sf_dir)), ["Evap_tavg"])


def snk05_training_table(spark, sf_dir):
    cells = P.grid_cells(P.grids(_grid_files(spark, sf_dir)), ["Evap_tavg"]).withColumnRenamed("file", "time")
    points = spark.createDataFrame([(10.2, 50.1), (10.26, 50.44), (15.0, 50.0), (10.5, 50.5)], "lon double, lat double")
    return P.training_table(cells, points, (10.0, 0.1, 6, 50.0, 0.1, 5), ["Evap_tavg"]).select("longitude", "latitude", F.round("cell_longitude", 6).alias("cell_longitude"), F.round("cell_latitude", 6).alias("cell_latitude"), "time", "Evap_tavg")


def j05_nearest_cell(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    return d.select("event_id", P.nearest_index(F.col("lon"), -179.95, 0.1, 3600).alias("x"), P.nearest_index(F.col("lat"), -59.95, 0.1, 1500).alias("y"))


def src19_points(spark, sf_dir):
    head = spark.createDataFrame([(0, "﻿Name, LAT ,Longitude")], "line_no long, line string")
    d = view(spark, sf_dir, "detections").select(F.col("event_id") + 1, F.concat_ws(",", F.lit("p"), F.when(F.col("event_id") % 8 == 0, F.lit("?")).otherwise(F.format_string("%.2f", "lat")), F.format_string("%.2f", "lon")))
    return P.points_table(head.union(d)).select("line_no", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


_GOES = PullRequest(dt.date(2025, 4, 5), dt.date(2025, 4, 9), BBox(-100.0, 30.0, -80.0, 40.0), limit=500)
_NOW = dt.datetime(2025, 4, 9, 18, 30)


def src09_goes_search(spark, sf_dir):
    """Days on either side of the day on which one satellite took over from another; every ninth key has no time."""
    d = view(spark, sf_dir, "detections").withColumn("at", F.expr("timestamp '2025-04-04 00:00:00' + make_dt_interval(0, 0, 0, event_id * 7919 % 600000)"))
    bucket = F.element_at(F.array(*map(F.lit, ("noaa-goes16", "noaa-goes19", "noaa-goes18"))), (F.col("event_id") % 3 + 1).cast("int"))
    product = F.when(F.col("event_id") % 4 == 0, "ABI-L2-MCMIPF").otherwise("ABI-L2-MCMIPC")
    start = F.when(F.col("event_id") % 9 == 0, "_s2025").otherwise(F.date_format("at", "'_s'yyyyDDDHHmmss'0'"))
    keys = d.select(bucket.alias("bucket"), F.concat(product, F.date_format("at", "'/'yyyy'/'DDD'/'HH'/OR'"), start, F.lit("_"), F.col("event_id").cast("string"), F.lit(".nc")).alias("key"))
    return listings.goes_search(keys.union(keys), _GOES, _NOW).select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "platform", "href")


def src10_himawari_search(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    at = F.expr("timestamp '2025-04-01 00:00:00' + make_dt_interval(0, 0, cast(event_id * 10 % 14400 as int), 0)")
    keys = d.select(F.concat(F.lit("AHI-L1b-FLDK/x/HS_H09_"), F.date_format(at, "yyyyMMdd_HHmm"), F.lit("_B0"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("_FLDK_R10_S0110.DAT.bz2")).alias("key"))
    r = PullRequest(dt.date(2025, 4, 2), dt.date(2025, 4, 9), BBox(150.0, -10.0, -170.0, 10.0), limit=200)
    return listings.himawari_search(keys, r, _NOW).select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.size("assets").alias("n"))


_FIRES = PullRequest(dt.date(2024, 1, 1), dt.date(2024, 1, 25), DATELINE, limit=3000)
_TODAY = dt.date(2024, 1, 24)


def src07_fire_search(spark, sf_dir):
    """Both sides of 180 degrees and three spans of days, answered with lines that come back from more than one request."""
    asked = listings.fire_requests(spark, _FIRES, _TODAY)
    d = view(spark, sf_dir, "detections").withColumn("turn", (F.col("event_id") % 7).cast("int"))
    line = F.concat_ws(",", F.format_string("%.4f", F.col("lat")), F.format_string("%.4f", F.col("lon")), F.lit("1"), F.lit("1"), F.lit("1"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HHmm"), F.lit("N"), F.lit("VIIRS"), F.lit("n"), F.lit("2"), F.lit("2"), F.lit("3.5"), F.lit("D"))
    rows = d.select("turn", F.col("event_id").alias("line_no"), line.alias("line"))
    again = rows.filter("line_no % 5 = 0").withColumn("turn", (F.col("turn") + 1) % 7).withColumn("line", F.regexp_replace("line", ",N,", ",again,"))
    answers = rows.union(again).join(F.broadcast(asked), "turn").select("area", "last", "line_no", "line")  # six requests
    return listings.fire_search(answers, _FIRES, "VIIRS_SNPP_NRT", _TODAY).select("id", "ord.turn", "ord.line_no", "platform")


_OK = "FROM scenes WHERE ord % 37 <> 0 AND ord % 31 <> 0"
_BOX = "CASE WHEN ord % 23 = 0 THEN greatest(-180, west - 0.01) ELSE west END AS west, CASE WHEN ord % 23 = 0 THEN greatest(-90, south - 0.01) ELSE south END AS south, CASE WHEN ord % 23 = 0 THEN least(180, west + 0.01) ELSE east END AS east, CASE WHEN ord % 23 = 0 THEN least(90, south + 0.01) ELSE north END AS north"
_CLOUD = "CASE WHEN ord % 2 = 0 THEN cloud WHEN ord % 5 = 0 THEN NULL ELSE cloud END AS cloud"
_PLATFORM = "CASE ord % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' ELSE 'unknown' END AS platform"
_GRID = """, n AS (SELECT n // 30 AS file, n % 30 AS i, CASE WHEN n % 13 = 0 THEN -9999.0 ELSE n * 1.5 END AS v FROM numbered),
full_ AS (SELECT file FROM n GROUP BY file HAVING count(*) = 30), cells AS (SELECT 'm' || file AS file, CAST(i % 6 AS INT) AS x, CAST(i // 6 AS INT) AS y, CASE WHEN v <> -9999 THEN CAST(v AS DOUBLE) END AS Evap_tavg FROM n WHERE file IN (SELECT file FROM full_))
"""

QUERIES = {
    "n01_stac_items": (n01_stac_items, oracle("scenes", f"SELECT ord, 'I' || ord AS id, ts, {_BOX}, CASE WHEN ord % 23 = 0 THEN 'point' ELSE 'polygon' END AS geometry_kind, lon, lat, CASE WHEN ord % 3 = 0 THEN 10.0 ELSE 30.0 END AS gsd_m, {_PLATFORM}, 'msi' AS instrument, {_CLOUD} {_OK}")),
    "n01f_stac_assets": (
        n01f_stac_assets,
        oracle("scenes", f"""SELECT ord, 'B04' AS key, 'https://bucket.s3.amazonaws.com/a/' || ord || '.tif' AS href, 'image/tiff' AS media_type, 0.0001 AS scale, -0.1 AS offset, CASE WHEN ord % 2 = 0 THEN ord END AS size_bytes, CAST(1 AS INT) AS n_roles {_OK}
UNION ALL SELECT ord, k, 'https://e.x/' || substr(k, 1, 1), NULL, NULL, NULL, NULL, 0 FROM (SELECT ord, unnest(['near', 'visual']) AS k {_OK})"""),
    ),
    "n11_band_aliases": (n11_band_aliases, oracle("scenes", f"SELECT ord, 'red' AS band, 'B04' AS key {_OK} UNION ALL SELECT ord, 'nir', 'near' {_OK}")),
    "n12_alias_overrides": (n12_alias_overrides, oracle("scenes", f"SELECT ord, 'red' AS band, 'C02_2km' AS key {_OK} UNION ALL SELECT ord, 'nir', 'near' {_OK} UNION ALL SELECT ord, 'blue', 'C01_2km' {_OK}")),
    "src02_stac_pages": (src02_stac_pages, oracle("scenes", f"SELECT 'I' || ord AS id, {_CLOUD}, {_PLATFORM} {_OK}")),
    "src03_by_ids": (src03_by_ids, oracle("scenes", "SELECT ord, id FROM scenes WHERE ord % 997 % 10 = 0")),
    "src05_next_cursor": (src05_next_cursor, "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'https://a/s' END AS href, CASE WHEN page_id % 3 <> 0 THEN 'true' END AS merge, CASE WHEN page_id % 3 <> 0 THEN 't' || page_id END AS token FROM pages"),
    "n07_stamped": (n07_stamped, oracle("scenes", "SELECT ord, CASE WHEN ord % 2 = 0 THEN source ELSE 'asked' END AS source, CASE WHEN ord % 3 = 0 THEN 'c-asked' ELSE collection END AS collection FROM scenes")),
    "n02_cmr_granules": (
        n02_granules,
        oracle("scenes", "SELECT ord, 'G' || ord AS id, ts, west, south, east, north, CASE WHEN ord % 3 = 0 THEN 'polygon' ELSE 'bbox' END AS geometry_kind, cloud, 'https://x/' || ord || '.hdf' AS data_href, 'MODIS' AS platform FROM scenes WHERE west <= east"),
    ),
    "n03_fire_lines": (
        n03_fire_lines,
        oracle("detections", """SELECT ord, 'VIIRS_SNPP_NRT:' || printf('%.4f', lat) || ':' || printf('%.4f', lon) || ':' || strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H%M') AS id, date_trunc('minute', ts) AS ts,
  round(greatest(-180, lon - 0.01), 6) AS west, round(least(90, lat + 0.01), 6) AS north, CASE WHEN event_id % 4 = 0 THEN 'Suomi NPP' ELSE 'N' END AS platform, CAST(frp_cents AS DOUBLE) AS frp FROM detections WHERE event_id % 17 <> 0"""),
    ),
    "snk03_detections_table": (
        snk03_detections_table,
        oracle("detections", """SELECT 'VIIRS_SNPP_NRT:' || printf('%.4f', lat) || ':' || printf('%.4f', lon) || ':' || strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H%M') AS id, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS time,
  CASE WHEN event_id % 4 = 0 THEN 'Suomi NPP' ELSE 'N' END AS platform, 'n' AS confidence FROM detections WHERE event_id % 17 <> 0"""),
    ),
    "n04_goes_keys": (n04_goes_keys, oracle("detections", "SELECT ord, date_trunc('second', ts) AS ts, 'GOES-East' AS platform, CAST(37 + length('ABI-L2-MCMIPC/2024/001/00/OR_ABI-L2-MCMIPC-M6_G16_s') + 13 + 6 + length(CAST(event_id AS VARCHAR)) + 3 AS INT) AS n FROM detections WHERE event_id % 9 <> 0")),
    "n05_himawari_slots": (
        n05_himawari_slots,
        oracle("detections", "SELECT 'HS_H09_' || strftime(ts, '%Y%m%d_%H00') AS id, date_trunc('hour', ts) AS ts, CAST(2 * count(DISTINCT event_id % 3) AS INT) AS n FROM detections GROUP BY 1, 2"),
    ),
    "src08_day_previews": (
        src08_day_previews,
        oracle("scenes", """, p(side, w, e, width) AS (VALUES ('east', 150.0, 180.0, 171), ('west', -180.0, -140.0, 228))
SELECT 'MODIS_Terra:' || strftime(ts, '%Y-%m-%d') || ':' || side AS id, CAST(ts AS DATE) AS day, CAST(width AS INT) AS width, CAST(512 AS INT) AS height, count(*) AS n, min(ord) AS first_ord
FROM scenes, p WHERE CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-01-01' + 699 AND north >= -45 AND south <= 45
  AND ((west <= e AND w <= CASE WHEN west > east THEN 180 ELSE east END) OR (west > east AND -180 <= e AND w <= east)) GROUP BY ALL"""),
    ),
    "src11_listing_pages": (src11_listing_pages, "SELECT p_partkey % 40 AS page, CAST(CASE WHEN p_partkey % 40 % 10 = 9 THEN 0 ELSE count(*) END AS INT) AS n_keys, CAST(CASE WHEN p_partkey % 40 % 10 = 9 THEN 0 ELSE 1 END AS INT) AS n_prefixes FROM part GROUP BY p_partkey % 40"),
    "src12_catalog_tree": (
        src12_catalog_tree,
        oracle("scenes", """, own AS (SELECT ord AS id, ord % 300 AS parent, ts, west, south, east, north FROM scenes WHERE west <= east),
acq AS (SELECT parent AS id, parent % 60 AS parent, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM own GROUP BY ALL),
ev AS (SELECT parent AS id, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north, min(first) AS first, max(last) AS last FROM acq GROUP BY parent),
e2 AS (SELECT id FROM ev WHERE (id % 7 = 0 OR (north >= -45 AND south <= 45 AND (east >= 150 OR west <= -140))) AND first <= DATE '1995-12-31' AND last >= DATE '1995-01-01' ORDER BY id LIMIT 40),
a2 AS (SELECT id FROM acq WHERE parent IN (SELECT id FROM e2) AND north >= -45 AND south <= 45 AND (east >= 150 OR west <= -140) AND first <= DATE '1995-12-31' AND last >= DATE '1995-01-01')
SELECT id FROM own WHERE parent IN (SELECT id FROM a2) AND north >= -45 AND south <= 45 AND (east >= 150 OR west <= -140) AND CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"""),
    ),
    "src12_deep_tree": (src12_deep_tree, oracle("scenes", _deep_sql()).replace("WITH ", "WITH RECURSIVE ", 1)),
    "src01_one_call": (
        src01_one_call,
        oracle("scenes", f""", own AS (SELECT ord, ts, {_BOX}, {_CLOUD} {_OK})
SELECT 'I' || ord AS id, 'sentinel2' AS source, 'sentinel-2-l2a' AS collection, 'optical' AS kind, ts FROM own WHERE north >= -45 AND south <= 45
AND CASE WHEN west <= east THEN east >= 150 OR west <= -140 ELSE true END AND CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND (cloud IS NULL OR cloud <= 50)"""),
    ),
    "src04_place_time": (
        src04_place_time,
        oracle("stored candidates", """, b AS (SELECT s.id AS old_id, c.id, c.ts FROM stored s JOIN candidates c ON s.collection = c.collection AND c.ts BETWEEN s.ts - INTERVAL 60 SECOND AND s.ts + INTERVAL 60 SECOND
  AND s.west <= c.east AND c.west <= s.east AND s.south <= c.north AND c.south <= s.north)
SELECT old_id, id FROM b QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY ts, id) <= 20"""),
    ),
    "src13_model_granules": (src13_model_granules, oracle("scenes", "SELECT ord, 'G' || ord AS id, 'https://x/' || ord || '.dap' AS data_href FROM scenes WHERE west <= east AND ord % 4 <> 0")),
    "src20_manifest_rows": (
        src20_manifest_rows,
        oracle("scenes", """, g AS (SELECT DISTINCT ord % 300 AS file, source FROM scenes WHERE source <> 'src6' AND ord % 300 % 7 <> 0)
SELECT source, CASE WHEN file % 2 = 0 THEN '{"own":1}' ELSE '{"top":1}' END AS request, count(*) AS n FROM g GROUP BY ALL"""),
    ),
    "u06_stored_scenes": (
        u06_stored_scenes,
        oracle("scenes", """, s AS (SELECT *, ord % 300 AS file, source || '-' || CASE WHEN ord % 2 = 0 THEN '{"own":1}' ELSE '{"top":1}' END AS name FROM scenes WHERE ord % 300 IN (2, 3) AND source <> 'src6')
SELECT name AS source, id, CASE WHEN ord % 2 = 0 THEN collection END AS collection, CASE WHEN ord % 2 = 0 THEN ts END AS ts, CASE WHEN ord % 2 = 0 THEN west END AS west FROM s
QUALIFY row_number() OVER (PARTITION BY name, id ORDER BY ord % 2, ord) = 1"""),
    ),
    "src21_registry": (
        src21_registry,
        oracle("scenes", ", known(place, family, kind) AS (VALUES " + ", ".join(f"({i}, '{r[1]}', '{r[5]}')" for i, r in enumerate(registry.rows())) + f""")
SELECT k.family, k.kind, count(*) AS n, count(DISTINCT place) AS sources, max(ts) AS newest FROM scenes JOIN known k ON place = ord % {len(registry.rows())} GROUP BY ALL"""),
    ),
    "t01_search_and_estimate": (
        t01_search_and_estimate,
        oracle("scenes", f""", own AS (SELECT ord, ts, {_BOX}, {_CLOUD} {_OK}),
found AS (SELECT * FROM own WHERE north >= -45 AND south <= 45 AND CASE WHEN west <= east THEN east >= 150 OR west <= -140 ELSE true END
  AND CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND (cloud IS NULL OR cloud <= 50)),
both_sources AS (SELECT 'sentinel2' AS source, * FROM found UNION ALL SELECT 'hls_sentinel', * FROM found WHERE ord % 3 = 0)
SELECT source, CAST(NULL AS VARCHAR) AS error, count(*) AS n_scenes, min(cloud) AS cloud, count(*) FILTER (source <> 'sentinel2' OR ord % 4 <> 0) AS scene_count, CAST(0 AS BIGINT) AS known_bytes,
  count(*) FILTER (source <> 'sentinel2' OR ord % 4 <> 0) AS unknown_scenes, count(*) FILTER (source = 'sentinel2' AND ord % 4 = 0) AS already_present FROM both_sources GROUP BY source
UNION ALL SELECT 'naip', 'nothing has landed', NULL, NULL, NULL, NULL, NULL, NULL"""),
    ),
    "src09_goes_search": (
        src09_goes_search,
        oracle("detections", """, k AS (SELECT event_id, TIMESTAMP '2025-04-04' + to_seconds(event_id * 7919 % 600000) AS t FROM detections WHERE event_id % 9 <> 0 AND event_id % 4 <> 0 AND event_id % 3 <> 2)
SELECT id, t AS ts, 'GOES-East' AS platform, href FROM (SELECT 'OR_s' || strftime(t, '%Y%j%H%M%S') || '0_' || event_id || '.nc' AS id, t,
  'https://' || CASE event_id % 3 WHEN 0 THEN 'noaa-goes16' ELSE 'noaa-goes19' END || '.s3.amazonaws.com/ABI-L2-MCMIPC/' || strftime(t, '%Y/%j/%H/') || 'OR_s' || strftime(t, '%Y%j%H%M%S') || '0_' || event_id || '.nc' AS href
FROM k WHERE CAST(t AS DATE) BETWEEN DATE '2025-04-05' AND DATE '2025-04-09' AND t < TIMESTAMP '2025-04-09 18:00:00') ORDER BY t DESC, id DESC LIMIT 500"""),
    ),
    "src10_himawari_search": (
        src10_himawari_search,
        oracle("detections", """, k AS (SELECT TIMESTAMP '2025-04-01' + to_minutes(event_id * 10 % 14400) AS t, event_id % 3 AS b FROM detections)
SELECT 'HS_H09_' || strftime(t, '%Y%m%d_%H%M') AS id, t AS ts, CAST(count(DISTINCT b) AS INT) AS n FROM k WHERE CAST(t AS DATE) BETWEEN DATE '2025-04-02' AND DATE '2025-04-09' AND t <= TIMESTAMP '2025-04-09 15:30:00'
GROUP BY t ORDER BY t DESC LIMIT 200"""),
    ),
    "src07_fire_search": (
        src07_fire_search,
        oracle("detections", """, r AS (SELECT CAST(event_id % 7 AS INT) AS turn, event_id, lat, lon, ts, 'N' AS platform FROM detections UNION ALL SELECT CAST((event_id + 1) % 7 AS INT), event_id, lat, lon, ts, 'again' FROM detections WHERE event_id % 5 = 0),
f AS (SELECT turn, event_id AS line_no, platform, 'VIIRS_SNPP_NRT:' || printf('%.4f', lat) || ':' || printf('%.4f', lon) || ':' || strftime(ts, '%Y-%m-%d') || 'T' || strftime(ts, '%H%M') AS id FROM r WHERE turn < 6)
SELECT id, turn, line_no, platform FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, line_no) = 1 ORDER BY turn, line_no LIMIT 3000"""),
    ),
    "src14_grid_text": (src14_grid_text, oracle("numbered", _GRID + "SELECT file, x, y, Evap_tavg FROM cells")),
    "snk05_training_table": (
        snk05_training_table,
        oracle("numbered", _GRID + """, p(longitude, latitude, x, y) AS (VALUES (10.2::DOUBLE, 50.1::DOUBLE, 2, 1), (10.26, 50.44, 3, 4), (10.5, 50.5, NULL, NULL))
SELECT longitude, latitude, round(10 + x * 0.1, 6) AS cell_longitude, round(50 + y * 0.1, 6) AS cell_latitude, file AS time, Evap_tavg FROM cells JOIN p USING (x, y)"""),
    ),
    "j05_nearest_cell": (
        j05_nearest_cell,
        oracle("detections", """, r AS (SELECT event_id, lon, lat, CAST(least(greatest(round_even((lon + 179.95) / 0.1, 0), 0), 3599) AS INT) AS x, CAST(least(greatest(round_even((lat + 59.95) / 0.1, 0), 0), 1499) AS INT) AS y FROM detections)
SELECT event_id, CASE WHEN abs(lon - (-179.95 + x * 0.1::DOUBLE)) <= 0.05 + 1e-6 THEN x END AS x, CASE WHEN abs(lat - (-59.95 + y * 0.1::DOUBLE)) <= 0.05 + 1e-6 THEN y END AS y FROM r"""),
    ),
    "src19_points_csv": (src19_points, oracle("detections", "SELECT event_id + 1 AS line_no, round(lon, 4) AS lon, round(lat, 4) AS lat FROM detections WHERE event_id % 8 <> 0")),
}
