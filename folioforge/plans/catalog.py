"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "operators.words", "operators.compare", "operators.layout", "operators.flow", "operators.repairs", "operators.regions", "operators.images", "plans.selection", "plans.routing", "plans.planning", "sources.scans", "sources.files",
)


def _all() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found |= import_module(f"folioforge.{name}").QUERIES
    return found


def queries() -> dict[str, Query]:
    """Queries by name."""
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """SQL by name, where SQL can express the query on whole tables."""
    return {name: sql for name, (_, sql) in _all().items() if sql}
