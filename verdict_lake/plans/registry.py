"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(sql: str | None, f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register a function of Tables under its name, with SQL over the same views if SQL can express it."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[f.__name__] = with_views(sql)
    return f


def query(sql: str | None = None):
    return partial(add, sql)
