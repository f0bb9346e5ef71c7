"""What a user asks for in one call: a search of all sources of a kind, and what a download of the scenes would take."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.assets import estimate, picked_assets
from geoloom.operators.scenes import ranked
from geoloom.request import KINDS, PullRequest
from geoloom.sources import registry
from geoloom.sources.families import Source
from geoloom.tables import cut

#: Fixed value: the source whose answer is a table, not files.
TABLE_SOURCE = "fldas"
_FOUND = ("source", "id", "ord", "kind", "ts", "cloud", "west", "south", "east", "north", "assets")
_NOTHING = "nothing has landed"


def chosen(kind: str, names: list[str] | None = None) -> list[str]:
    """The sources to search: those named, or all of a kind. Unknown names, or names of another kind, are errors."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is no kind of data")
    of = {r[0]: r[5] for r in registry.rows()}
    unknown = sorted(set(names or []) - of.keys())
    if unknown:
        raise ValueError(f"unknown sources: {unknown}")
    other = sorted(n for n in names or [] if of[n] != kind)
    if other:
        raise ValueError(f"no sources of {kind}: {other}")
    found = list(dict.fromkeys(names)) if names else [n for n, k in of.items() if k == kind]
    if not found or TABLE_SOURCE in found:
        raise ValueError(f"no source with files of {kind}" if not found else f"{TABLE_SOURCE} makes a table, not files")
    return found


def search(landed: dict[str, DataFrame], request: PullRequest, kind: str, names: list[str] | None = None, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes, errors): the scenes of every source that has landed payloads, with rank, clearest first; and source and error
    of those that have none."""
    wanted = chosen(kind, names)
    there = [n for n in wanted if n in landed]
    if not there:
        raise ValueError("none of the sources has landed payloads")
    parts = []
    for name in there:
        found = Source.of(name).search(landed[name], request, now)
        lacking = {"kind": F.lit(kind), "cloud": F.lit(None).cast("double"), "assets": F.array().cast("array<struct<key:string,asset:struct<href:string,media_type:string,roles:array<string>,size_bytes:bigint>>>")}
        own = found.withColumns({c: v for c, v in lacking.items() if c not in found.columns}).withColumn("source", F.lit(name))
        asset = lambda a: F.struct(a["key"].alias("key"), a["asset"]["href"].alias("href"), a["asset"]["media_type"].alias("media_type"), a["asset"]["roles"].alias("roles"), a["asset"]["size_bytes"].alias("size_bytes"))
        parts.append(own.withColumn("assets", F.transform("assets", asset)).select(*_FOUND))
    # Payloads are read once: lists, counts and estimates come from what was found.
    scenes = ranked(cut(reduce(DataFrame.unionByName, parts), "pull-found"))
    spark = scenes.sparkSession
    errors = spark.createDataFrame([(n, _NOTHING) for n in wanted if n not in landed], "source string, error string")
    return scenes, errors


def estimated(scenes: DataFrame, errors: DataFrame, present: DataFrame, windowed: bool = False) -> DataFrame:
    """A row a source: error, n_scenes, cloud (the least) and what `assets.estimate` says of a download. present: source,
    scene of what is there."""
    assets = scenes.select("source", F.col("id").alias("scene"), F.posexplode_outer("assets").alias("pos", "a")).select("source", "scene", "pos", "a.*")
    size = estimate(picked_assets(assets), present, windowed)
    n = scenes.groupBy("source").agg(F.count("*").alias("n_scenes"), F.min("cloud").alias("cloud"))
    told = n.join(size, "source").withColumn("error", F.lit(None).cast("string"))
    return told.unionByName(errors, allowMissingColumns=True)
