"""What the corpus operators share: tables, the shared folder, joins with a checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoloom.tables import BROADCAST_ROWS, cut, join_checked, once, read, resolved, shared_dir

__all__ = ["BROADCAST_ROWS", "NARROW_ROWS", "WORD", "cut", "fresh", "join_small", "once", "read", "resolved", "shared_dir"]

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers each up to which a side is broadcast: some tens of MB.
NARROW_ROWS = 200_000


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to small, which is broadcast only if its rows, counted first, are few."""
    return join_checked(big, small, on, how, most)


def fresh(taken: list[str], stem: str) -> str:
    """A column name that is not taken (case-insensitively)."""
    names = {c.lower() for c in taken}
    while stem.lower() in names:
        stem += "_"
    return stem
