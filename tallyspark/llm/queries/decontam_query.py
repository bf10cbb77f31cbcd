from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.decontam import find_leaks

_TOKS = r"[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+') IF x <> '']"
_SHORT = " ".join(f"UNION ALL SELECT {n} AS span, toks AS win, item_id FROM b WHERE len(toks) = {n}" for n in range(8, 13))
# with at most two substitutions one of three blocks of a window agrees: another way to the same windows than the masks
SQL = f"""
WITH d AS (SELECT doc_id, {_TOKS} AS toks FROM documents), b AS (SELECT item_id, {_TOKS} AS toks FROM benchmark),
w0 AS (SELECT 13 AS span, toks[i:i + 12] AS win, item_id FROM (SELECT toks, item_id, unnest(range(1, len(toks) - 11)) AS i FROM b WHERE len(toks) >= 13) {_SHORT}),
w AS (SELECT span, win, min(item_id) AS item_id, count(DISTINCT item_id) AS items FROM w0 GROUP BY span, win),
n AS (SELECT DISTINCT span FROM w),
wk AS (SELECT span, win, item_id, items, k, array_to_string(win[1 + k * span // 3 : (k + 1) * span // 3], ' ') AS part FROM w, (VALUES (0), (1), (2)) v(k)),
p AS (SELECT doc_id, span, i, toks[i : i + span - 1] AS mine FROM (SELECT doc_id, toks, span, unnest(range(1, len(toks) - span + 2)) AS i FROM d, n WHERE len(toks) >= span)),
pk AS (SELECT doc_id, span, i, mine, k, array_to_string(mine[1 + k * span // 3 : (k + 1) * span // 3], ' ') AS part FROM p, (VALUES (0), (1), (2)) v(k)),
h AS (SELECT DISTINCT doc_id, i, span, item_id, items, win, mine FROM pk JOIN wk USING (span, k, part)),
s AS (SELECT doc_id, i, item_id, items, len([q FOR q IN range(1, span + 1) IF mine[q] <> win[q]]) AS subs, span FROM h)
SELECT doc_id, min(item_id) AS item_id, CAST(max(items) AS BIGINT) AS items, count(DISTINCT i) AS windows, CAST(min(i) - 1 AS INTEGER) AS first_at, CAST(min(subs) AS INTEGER) AS subs
FROM s WHERE subs <= CASE WHEN span = 13 THEN 2 ELSE 2 * span // 13 END GROUP BY doc_id
"""


@query("op4_benchmark_leaks", SQL)
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of 13 words of a benchmark item with at most 2 substitutions."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_leaks(read("documents"), read("benchmark"), exact_short=True).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "items", "windows", "first_at", "subs")
