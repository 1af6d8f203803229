"""Catalogue of queries: each a Spark callable, most with a SQL twin over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from connlens.plans.views_sql import VIEWS
from connlens.session import shipped

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` continues the WITH list of the shared views."""

    def add(run: Query) -> Query:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = shipped(run)
        if sql is not None:
            text = sql.strip()
            ORACLES[key] = f"WITH {VIEWS}{',' if text.startswith('+') else ''}\n{text.lstrip('+')}"
        return run

    return add
