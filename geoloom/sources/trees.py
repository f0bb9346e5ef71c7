"""Catalogs that are trees of any depth: walked level by level, each level cut at the extents that its nodes declare.

Nodes are rows: id, parent (null at the top), leaf (an item, or a catalog of more), edges and first and last day of the
extent (an item's own box and day; null where unknown, which lets through). Each level's nodes that may hold what is asked
for are written before the next is looked up: a walk is one equal join a level, whose small side is the frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import Box, intersects
from geoloom.functions.rings import overlaps_area
from geoloom.functions.times import overlap
from geoloom.request import PullRequest
from geoloom.tables import cut, join_checked

#: Levels beyond which a catalog is taken for one without end.
MOST_LEVELS = 64


def may_hold(request: PullRequest) -> Column:
    """Whether a declared extent meets the request; an unknown one lets through."""
    near = F.coalesce(intersects(Box.col(), Box.of(*request.bbox.edges)), F.lit(True))
    return near & overlap(F.col("first"), F.col("last"), F.lit(request.start), F.lit(request.end))


def walked(nodes: DataFrame, request: PullRequest, most_levels: int = MOST_LEVELS) -> DataFrame:
    """The leaves of nodes below catalogs that may hold what a request asks for, with level (1 at the top).

    A catalog that is reached at two levels hangs below itself, or is no tree's: an error, as is a walk of more than
    most_levels."""
    asked = nodes.filter(may_hold(request))
    own = asked.columns
    now = cut(asked.filter("parent IS NULL").withColumn("level", F.lit(1)), "tree-level")
    levels, seen = [now], now.filter("NOT leaf").select("id").distinct()
    while not (frontier := now.filter("NOT leaf").select(F.col("id").alias("parent")).distinct()).isEmpty():
        if len(levels) == most_levels:
            raise ValueError(f"a catalog of more than {most_levels} levels")
        below = join_checked(asked, frontier, ["parent"]).select(*own).withColumn("level", F.lit(len(levels) + 1))
        now = cut(below, "tree-level")
        again = join_checked(now.filter("NOT leaf").select("id"), seen, ["id"], "left_semi").first()
        if again is not None:
            raise ValueError(f"the catalog {again['id']} is reached at two levels")
        levels.append(now)
        seen = seen.union(now.filter("NOT leaf").select("id")).distinct()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.filter("leaf")


def items(nodes: DataFrame, request: PullRequest, most_levels: int = MOST_LEVELS) -> DataFrame:
    """The items of a tree that a request wants: of a known place and day that meet it."""
    found = walked(nodes, request, most_levels).filter("west IS NOT NULL AND first IS NOT NULL")
    return found.filter(overlaps_area(request.polygon or request.bbox, Box.col()))
