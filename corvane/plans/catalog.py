"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "corpus_summary"
MODULES = ("text_queries", "policy_queries", "stat_queries", "state_queries", "composite_queries")


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for module in MODULES:
        found |= import_module(f"{__package__}.{module}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registered().items() if sql}
