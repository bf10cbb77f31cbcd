from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.mixing import mix

SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(md5(CAST(doc_id AS VARCHAR)), '-') || ':' || coalesce(md5(text), '-')) AS key FROM documents),
n AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, key),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, cap / w AS level, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s1),
s3 AS (SELECT *, sum(cap) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + level * (sum(w) OVER () - sum(w) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) <= budget AS is_full FROM s2),
s4 AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS used, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS open_w FROM s3),
s AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least((budget - used) * w / open_w, cap) END AS target FROM s4),
r AS (SELECT n.source, n.key, n.size, floor(least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)) AS whole,
    least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) - floor(least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)) AS part,
    (CAST('0x' || key[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, target
  FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source),
k AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rnk,
    greatest(target - sum(size * whole) OVER (PARTITION BY source), 0.0) AS words_left FROM r),
c AS (SELECT *, CASE WHEN rnk IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk, key) END AS run FROM k),
g AS (SELECT source, words_left, coalesce(max(run) FILTER (run <= words_left), 0) AS got FROM c GROUP BY source, words_left),
f AS (SELECT c.source, first(c.key ORDER BY abs(c.size - (g.words_left - g.got)), c.rnk, c.key) AS key FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
  WHERE c.run > c.words_left AND c.size > 0 AND c.size < 2 * (g.words_left - g.got) GROUP BY c.source),
t AS (SELECT c.source, c.key, CAST(c.whole AS BIGINT) + CASE WHEN c.rnk IS NOT NULL AND (c.run <= c.words_left OR c.key = f.key) THEN 1 ELSE 0 END AS copies
  FROM c LEFT JOIN f ON c.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(d.size * t.copies AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN t ON d.source IS NOT DISTINCT FROM t.source AND d.key = t.key
"""


@query("op1_pareto_mix", SQL)
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: sources weigh 5, 2, 1 in turn, at most 3 epochs of a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    m = mix(docs)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
