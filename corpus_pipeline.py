"""From raw documents to a training mix: four stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.decontam import find_leaks
from tallyspark.llm.mixing import mix
from tallyspark.llm.simhash import near_duplicates
from tallyspark.llm.weak_labels import keep_good, text_key
from tallyspark.runtime import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier takes for good; texts without words go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more."""
    return near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. A leak is a property of the text, so rows are matched by text, whatever their ids."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("key"))
    leaks = materialize(find_leaks(keyed.select("key", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", exact_short=True).select(F.col("id").alias("key")), "leaks")
    return keyed.join(leaks, "key", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken at least once, with ``copies``, the number of times each is taken."""
    m = mix(docs)
    return m.where("mix_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"], F.col("mix_copies").alias("copies"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
]

#: The classifier's scores and the fingerprints cannot be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
