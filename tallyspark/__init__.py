"""Statistics and evidence analytics on Spark DataFrames."""

from tallyspark.registry import Result, analysis, catalog, run, run_steps

__all__ = ["Result", "analysis", "catalog", "run", "run_steps"]
