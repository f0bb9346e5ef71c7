"""Every query over the test tables: name -> function of (spark, sf_dir), and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans.scene_queries import a03_consolidate

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scene_queries", "function_queries", "record_queries", "pixel_queries", "source_queries", "stream_queries", "area_queries", "page_queries")


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        own = import_module(f"geoloom.plans.{name}").QUERIES
        assert not own.keys() & found.keys()
        found |= own
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a03_consolidate(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
