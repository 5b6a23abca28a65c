"""Names of the runnable queries, their Spark form and, where SQL can say it, their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"lintlake.plans.{module}")


MODULES = ("scan_queries", "finding_queries", "site_queries", "project_queries")
