"""Queries over the whole training-data tables, one for each operator, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ("mixing_query", "decontam_query", "quality_query", "html_query", "separator_query", "licence_query", "warc_query", "dual_tree_query", "chat_query", "simhash_query", "align_query", "repair_query", "toxicity_query")


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir) -> DataFrame``; ``sql`` is left out where SQL cannot express the result."""

    def wrap(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for m in MODULES:
        import_module(f"tallyspark.llm.queries.{m}")
    return dict(QUERIES), dict(SQL)
