from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.catalog import query
from tallyspark.llm.warc import archive_pages

SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top OR top IS NULL THEN NULL ELSE top END AS refers_to
FROM m
"""


@query("op5_warc_round_trip", SQL)
def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archive of every page."""
    back = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
