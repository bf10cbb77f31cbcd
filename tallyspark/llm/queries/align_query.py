from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.catalog import query
from tallyspark.llm.token_align import align_tokens

#: Side A and side B.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Groups and links between two tokenizers over the bytes of every document."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_level, pieces).withColumnRenamed("id", "doc_id")
