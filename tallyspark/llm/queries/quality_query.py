from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.weak_labels import THRESHOLD, fit_quality


@query("op7_weak_label_quality")
def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = fit_quality(docs).score(spark)
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("keep"))
