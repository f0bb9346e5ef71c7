"""The manifest: one row a source with what has been found, saved, skipped and failed; upserts and resumed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.times import parsed

SCHEMA = """source string, ord bigint, request_hash string, collection string, next_cursor string, error string, cursor_rejected boolean,
scene_ids array<string>, saved array<string>, skipped array<string>, previews array<string>,
failed array<struct<id:string,error:string>>, windows array<struct<id:string,bytes_read:bigint,granule_size:bigint>>"""
LISTS = ("scene_ids", "saved", "skipped", "previews")


def request_hash(*parts: Column) -> Column:
    """A digest by which runs of one request know each other; a limit is no part of it."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def ordered_distinct(a: Column, b: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))


def _keyed(old: Column, new: Column, last: bool) -> Column:
    """Entries by id, each at the place of its first; its value is that of the last or of the first. By sorting, so that
    long lists take no more than their length times its logarithm."""
    let = lambda value, body: F.transform(F.array(value), body)[0]
    every = F.concat(F.coalesce(old, F.filter(new, lambda x: F.lit(False))), F.coalesce(new, F.filter(old, lambda x: F.lit(False))))
    placed = F.array_sort(F.transform(every, lambda x, i: F.struct(x["id"].alias("id"), i.alias("at"), x.alias("x"))))

    def ends(s: Column) -> Column:
        ids = F.transform(s, lambda x: x["id"])
        none = F.array(F.lit(None).cast("string"))
        before, behind = F.concat(none, F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))), F.concat(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), none)
        first = F.filter(F.zip_with(s, before, lambda x, p: F.when(~x["id"].eqNullSafe(p), x)), lambda x: x.isNotNull())
        final = F.filter(F.zip_with(s, behind, lambda x, p: F.when(~x["id"].eqNullSafe(p), x)), lambda x: x.isNotNull())
        both = F.zip_with(first, final, lambda f, z: F.struct(f["at"].alias("at"), (z if last else f)["x"].alias("x")))
        return F.transform(F.array_sort(both), lambda e: e["x"])

    return let(placed, ends)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of a resumed run on top of those of the run before, by source."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.source") == F.col("b.source"), "full")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    fresh, failed = F.col("b.source").isNotNull(), F.col("b.error").isNotNull()
    rejected = F.coalesce(F.col("b.cursor_rejected"), F.lit(False))
    # A run that failed keeps the cursor of the one before, unless the catalog has refused it.
    cursor = F.when(~fresh | (failed & ~rejected), F.col("a.next_cursor")).when(rejected, None).otherwise(F.col("b.next_cursor"))
    return both.select(
        pick("source").alias("source"),
        F.coalesce("a.ord", "b.ord").alias("ord"),
        pick("request_hash").alias("request_hash"),
        pick("collection").alias("collection"),
        cursor.alias("next_cursor"),
        F.when(fresh, F.col("b.error")).otherwise(F.col("a.error")).alias("error"),
        F.lit(False).alias("cursor_rejected"),
        *[ordered_distinct(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in LISTS],
        _keyed(F.col("a.failed"), F.col("b.failed"), last=True).alias("failed"),
        _keyed(F.col("a.windows"), F.col("b.windows"), last=False).alias("windows"),
    )


def upserted(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of this run in place of those of the same sources; new sources behind the others, in order."""
    old, new = existing.select("source", F.col("ord").alias("old_ord")), fresh.withColumnRenamed("ord", "new_ord")
    kept = existing.join(fresh.select("source"), "source", "left_anti").withColumn("_tier", F.lit(0))
    put = new.join(old, "source", "left").withColumn("_tier", F.when(F.col("old_ord").isNull(), 1).otherwise(0))
    put = put.withColumn("ord", F.coalesce("old_ord", "new_ord")).drop("old_ord", "new_ord")
    return kept.unionByName(put)


def stale(recorded: DataFrame, run: DataFrame) -> DataFrame:
    """Files that an earlier run of the same source and request has left and this run has not written again."""
    return recorded.join(run.select("source", "request_hash").distinct(), ["source", "request_hash"], "left_semi").join(
        run.select("source", "path"), ["source", "path"], "left_anti"
    )


def resumed_from(manifest: DataFrame, request: Column) -> DataFrame:
    """source, action, cursor of the next run: a page to go on from, none that is left, or the first page again. A cursor
    that the catalog has refused, with an error, isn't a search that failed: it doesn't begin again by itself."""
    same = F.col("request_hash").eqNullSafe(request)
    failed = F.col("error").isNotNull() & F.col("next_cursor").isNull() & ~F.coalesce(F.col("cursor_rejected"), F.lit(False))
    action = F.when(~same | failed, "restart").when(F.col("next_cursor").isNull(), "exhausted").otherwise("resume")
    return manifest.select("source", action.alias("action"), F.when(same, F.col("next_cursor")).alias("cursor"))


def cursor_kind(next_href: Column, search_url: Column, method: Column) -> Column:
    """What a next-page link is good for: reuse, or not, as it is signed, of another origin, or a bare repeat."""
    from geoloom.functions.text import is_signed

    origin = lambda u: F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return (
        F.when(next_href.isNull() | (F.trim(next_href) == ""), "none")
        .when(is_signed(next_href), "signed")
        .when(origin(next_href) != origin(search_url), "cross-origin")
        .when((F.upper(method) == "GET") & (next_href == search_url), "bare")
        .otherwise("page")
    )


_SCENE = "struct<id:string,collection:string,datetime:string,footprint:array<double>>"


def source_rows(files: DataFrame) -> DataFrame:
    """ord (place in the file), source, request (JSON text) and row (JSON text) of the source rows of manifests (text). A row
    without a request has the file's; a file that is no manifest, and a row without a source's name, have none."""
    v = F.try_parse_json("text")
    whole = files.select(F.try_variant_get(v, "$.sources", "array<variant>").alias("rows"), F.to_json(F.try_variant_get(v, "$.request", "variant")).alias("top"))
    item = whole.select("top", F.posexplode("rows").alias("ord", "item"))
    name, own = F.try_variant_get("item", "$.source", "string"), F.try_variant_get("item", "$.request", "variant")
    text = F.schema_of_variant(F.try_variant_get("item", "$.source", "variant")) == "STRING"
    request = F.when(F.schema_of_variant(own).startswith("OBJECT"), F.to_json(own)).otherwise(F.col("top"))
    return item.filter(text & (name != "")).select(F.col("ord").cast("bigint").alias("ord"), name.alias("source"), request.alias("request"), F.to_json("item").alias("row"))


def stored_scenes(rows: DataFrame) -> DataFrame:
    """source, ord, id, collection, ts and edges of the scenes that manifest rows (source, row: JSON text) know: those with a
    place and time first, then bare ids; of an id the first."""
    v = F.parse_json("row")
    rich = F.try_variant_get(v, "$.scenes", "array<variant>")
    bare = F.try_variant_get(v, "$.scene_ids", "array<variant>")

    def word(x: Column, path: str) -> Column:
        found = F.try_variant_get(x, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(x, path, "string"))

    one = lambda x: F.coalesce(word(x, "$.id"), word(x, "$"))
    every = F.concat(
        F.transform(F.coalesce(rich, F.array().cast("array<variant>")), lambda x: F.struct(one(x).alias("id"), F.from_json(F.to_json(x), _SCENE).alias("s"))),
        F.transform(F.coalesce(bare, F.array().cast("array<variant>")), lambda x: F.struct(word(x, "$").alias("id"), F.lit(None).cast(_SCENE).alias("s"))),
    )
    found = rows.select("source", F.posexplode(every).alias("ord", "x")).filter("x.id <> ''")
    first = found.groupBy("source", "x.id").agg(F.min(F.struct("ord", "x.s")).alias("f"))
    edge = lambda i: F.get(F.col("f.s.footprint"), F.lit(i))
    return first.select(
        "source", F.col("f.ord").cast("bigint").alias("ord"), "id", F.nullif(F.col("f.s.collection"), F.lit("")).alias("collection"), parsed(F.col("f.s.datetime")).alias("ts"),
        *[edge(i).alias(n) for i, n in enumerate(("west", "south", "east", "north"))],
    )
