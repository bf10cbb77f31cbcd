from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.separator_scan import remove, scan_separators, write_tokens
from tallyspark.llm.shared_files import new_folder
from tallyspark.runtime import materialize

#: A vocabulary of 50,256 byte pairs; the next number is free and closes documents.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@query("op3_separator_token_counts")
def op3_separator_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Number of tokens of every document, counted in flat token files by their separators."""
    import public_tokenizers

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), new_folder(spark, "tokens")
    written = materialize(write_tokens(docs, folder, vocabulary, public_tokenizers.PATTERN), "written")
    counts = materialize(scan_separators(written.select("file", "size").distinct()), "counts")
    remove(folder)
    order = written.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return counts.join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
