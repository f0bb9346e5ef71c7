"""Columns of the tables that the operators work on, and the rules that a row of scenes keeps to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.request import KINDS

BOX = "west double, south double, east double, north double"
ASSET = "struct<href:string,media_type:string,title:string,roles:array<string>,scale:double,offset:double,size_bytes:bigint>"
#: Flat edges, so that a filter on the area reaches the scan.
SCENES = f"""ord bigint, id string, source string, collection string, kind string, ts timestamp, start_ts timestamp, end_ts timestamp,
{BOX}, geometry_kind string, lon double, lat double, gsd_m double, platform string, instrument string, cloud double,
footprint_is_request boolean, assets array<struct<key:string,asset:{ASSET}>>, band_aliases map<string,string>, properties map<string,string>"""


def valid_box() -> Column:
    edges = [F.col(c) for c in ("west", "south", "east", "north")]
    known = F.lit(True)
    for e in edges:
        known = known & e.isNotNull() & ~F.isnan(e)
    return known & F.col("west").between(-180, 180) & F.col("east").between(-180, 180) & (F.col("south") >= -90) & (F.col("south") <= F.col("north")) & (F.col("north") <= 90)


def valid_scene() -> Column:
    """The invariants of a scene; never null."""
    rules = [
        F.col("id").isNotNull() & (F.col("id") != ""),
        F.col("ts").isNotNull(),
        F.col("kind").isin(*KINDS),
        valid_box(),
        (F.col("geometry_kind") != "point") | (F.col("lon").isNotNull() & F.col("lat").isNotNull()),
        F.col("cloud").isNull() | F.col("cloud").between(0, 100),
        F.col("gsd_m").isNull() | (F.col("gsd_m") > 0),
        F.col("end_ts").isNull() | F.col("start_ts").isNull() | (F.col("end_ts") >= F.col("start_ts")),
    ]
    ok = F.lit(True)
    for rule in rules:
        ok = ok & F.coalesce(rule, F.lit(False))
    return ok


def split_valid(scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes that keep to the rules, those that don't)."""
    return scenes.filter(valid_scene()), scenes.filter(~valid_scene())
