"""Registered queries: one Spark job per operator, with a SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` computes the same rows in plain SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def r6(c, name: str | None = None) -> Column:
    """Round to 6 digits (2 for large values), without a negative zero.

    The small shift keeps exact decimal ties from rounding by summation order.
    """
    col = F.col(c) if isinstance(c, str) else c
    out = (
        F.when(F.abs(col) < 5.0005e-7, F.lit(0.0))
        .when(F.abs(col) >= 1e4, F.round(col + F.lit(1e-5), 2))
        .otherwise(F.round(col + F.lit(1e-10), 6))
    )
    return out.alias(name or (c if isinstance(c, str) else "value"))


def s6(expr: str) -> str:
    """SQL text of ``r6``."""
    return (f"CASE WHEN abs({expr}) < 5.0005e-7 THEN 0.0::DOUBLE WHEN abs({expr}) >= 1e4 THEN round(({expr})::DOUBLE + 1e-5, 2) "
            f"ELSE round(({expr})::DOUBLE + 1e-10, 6) END")
