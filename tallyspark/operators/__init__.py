"""Operators on DataFrames, one module per family."""

from importlib import import_module

MODULES = (
    "describe", "order_stats", "hypothesis", "rank_tests", "correlate", "linear", "scales", "agreement", "sets", "coding", "bounds", "network", "screening", "audit", "quality", "report",
    "glm", "overlap", "survival", "choice",
)


def load_all() -> None:
    for m in MODULES:
        import_module(f"tallyspark.operators.{m}")
