"""Reading input tables, writing result tables, the run ledger and the run manifest."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or parquet by file suffix; a CSV without a schema is inferred."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt", "tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if kind in ("parquet", "pq"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"unsupported suffix {kind!r}: convert the table to csv or parquet")


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; only the empty string is missing, so 'NA' and 'None' stay text."""
    if path.rstrip("/").lower().endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
        return df.select([F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(c) for c in df.columns])
    head = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    return spark.read.schema(names).option("header", True).option("nullValue", "").option("multiLine", False).csv(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """An increasing id in reading order, for rules where the first row wins."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Every result table of a run as parquet under its own name."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def append_ledger(spark: SparkSession, path: str, run: str, counts: Mapping[str, int], rules: str = "") -> None:
    """Append one record per run to an append-only ledger."""
    row = spark.range(1).select(
        F.lit(run).alias("run"),
        F.current_timestamp().alias("recorded_at"),
        F.lit(rules).alias("rules"),
        F.lit(json.dumps(dict(counts), sort_keys=True)).alias("counts"),
    )
    row.write.mode("append").parquet(path)


def table_fingerprint(df: DataFrame, table: str = "table") -> DataFrame:
    """Order-free fingerprint of a table: row count, and sum and xor of the row hashes."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
    # the sum is taken on two 32-bit halves so that it cannot overflow
    return df.select(h.alias("h")).agg(
        F.lit(table).alias("table"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.shiftrightunsigned("h", 32).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_high"),
        F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_low"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"),
    )


def run_manifest(
    spark: SparkSession, name: str, params: Mapping, inputs: Mapping[str, DataFrame], outputs: Mapping[str, DataFrame], seed: int | None = None
) -> DataFrame:
    """One audit row per input and output table of a run."""
    from functools import reduce

    parts = [
        table_fingerprint(t, k).withColumn("role", F.lit(role))
        for role, group in (("input", inputs), ("output", outputs))
        for k, t in group.items()
    ]
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(name).alias("analysis"),
        F.lit(json.dumps(dict(params), sort_keys=True, default=str)).alias("params"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(spark.version).alias("spark_version"),
        F.current_timestamp().alias("created_at"),
        "role", "table", "rows", "sum_high", "sum_low", "xor",
    )
