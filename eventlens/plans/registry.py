"""Registry of the named queries bound to the driver's test tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` plus, where the result is
SQL-expressible, the DuckDB text of the same query (the oracle).
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import with_views


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register ``fn`` under ``name``; ``sql`` is prefixed with the view CTEs."""

    def deco(fn):
        text = None if sql is None else (with_views(sql) if views else sql)
        REGISTRY[name] = Entry(name, fn, text)
        return fn

    return deco
