"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_GROUPS = ["transcripts", "timeline", "warehouse", "ingest", "specs", "search", "streams"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for group in _GROUPS:
        found.update(import_module(f"timeline_lake.catalog.{group}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for group in _GROUPS:
        found.update(import_module(f"timeline_lake.catalog.{group}").ORACLES)
    return found
