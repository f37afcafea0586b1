"""Registered queries: name to callable, and name to the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["group_mean_se"](spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"eventloom.plans.{name}")


MODULES = ["interval_queries", "peri_queries", "stats_queries", "scalar_queries", "model_queries", "recording_queries", "access_queries", "closed_form_queries", "source_queries", "paradigm_queries", "hermite_queries", "scan_queries", "learning_queries", "neighbour_queries"]
load()
