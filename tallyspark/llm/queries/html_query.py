from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.catalog import query
from tallyspark.llm.html_cut import extract


@query("op2_min_cut_text")
def op2_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
