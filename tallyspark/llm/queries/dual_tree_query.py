from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.catalog import query
from tallyspark.llm.dual_tree import top_k

SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(vec) AS c, generate_subscripts(vec, 1) AS i, len(vec) AS dim FROM v),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(sum(q.c * p.c) AS BIGINT) AS score FROM e q JOIN e p ON q.i = p.i AND q.dim = p.dim WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id GROUP BY q.vec_id, p.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op8_dual_tree_top_k", SQL)
def op8_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose number is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id % 20 = 0")
