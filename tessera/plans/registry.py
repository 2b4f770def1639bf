"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RETAIL_SNAPSHOT = "2001-01-01"
EVENT_SNAPSHOT = "2024-01-31"


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL if there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(value: str | Column, digits: int) -> Column:
    """Rounded double without a negative zero, as r() gives it in SQL."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def r(expression: str, digits: int) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"
