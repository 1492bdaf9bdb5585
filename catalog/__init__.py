"""Registered queries: the library's operators on the supplied star-schema tables.

Roles are played by stand-ins: operation = order, station = customer, basin =
nation, species = part brand, count = quantity, protocol = order priority. Only
this package knows about them. Each query carries, where SQL can say it, the
statement a second engine must agree with.
"""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from creel.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its statement under a key."""

    def register(f: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = wraps(f)(lambda spark, sf: f(tune(spark), sf))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def load_all() -> None:
    from catalog import aggregates, diversity, expressions, flows, models, places, tables  # noqa: F401
