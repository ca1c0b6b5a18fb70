"""The registry of queries and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deckframe.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str, function: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Register ``function`` over ``views`` (names, in the order of its arguments) and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: function(*(view(spark, sf_dir, v) for v in views.split()))
    if sql:
        SQL[name] = with_views(sql)
