"""The registry behind ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the equivalent SQL where one exists."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module once and return the full registry."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"fieldspark.plans.{module}")
    return QUERIES, SQL


MODULES = ["q_masks", "q_rules", "q_labels", "q_routes", "q_pixels", "q_models", "q_tracks", "q_files"]
