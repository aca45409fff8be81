"""Every named query and, where SQL can express it, the SQL for the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("frames", "regions", "scores", "traces", "tiling", "matching_motion", "files", "synthetic", "streams")


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with its SQL."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"glimmer.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
