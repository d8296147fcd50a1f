"""Every query of the engine by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brookline.sources.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name; sql comes after the domain views."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return register


def load() -> None:
    """Import the modules that register queries."""
    from brookline.plans import activity, context, facts, ingest, lookups, market, operations, posts, relationships, series, storage, streams  # noqa: F401
