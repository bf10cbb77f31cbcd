from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.toxicity import fit_toxicity


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of learning; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op13_toxicity_grammar")
def op13_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is toxic, learned from the labels of four documents in five."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs.where(~held_out()), labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(spark)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
