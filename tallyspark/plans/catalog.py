"""Named queries on the supplied tables with the SQL each one is compared against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ("describe_queries", "inference_queries", "model_queries", "scale_queries", "network_queries", "screening_queries", "audit_queries", "source_queries")


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir) -> DataFrame``; ``sql`` is omitted where plain SQL cannot express the result."""

    def wrap(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for m in MODULES:
        import_module(f"tallyspark.plans.{m}")
    return dict(QUERIES), dict(SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the floating-point columns, so that the order of summation does not show; -0.0 becomes 0.0."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((F.round(c, digits) + F.lit(0.0)).alias(name) if kind in ("double", "float") else c)
    return df.select(cols)
