from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.repair import digest_lines, repair_conversations

_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _put(path: str, cost: str, letter: str, line: str | None) -> str:
    """SQL for a path with one more edit; a path is its cost, letters and lines, or null."""
    lines = f"{path}.o" if line is None else f"list_append({path}.o, {line})"
    return f"CASE WHEN {path} IS NOT NULL THEN {{'c': {path}.c + {cost}, 'a': {path}.a || '{letter}', 'o': {lines}}} END"


def _new(path: str, role: str) -> str:
    return _put(path, "2", "I", f"'{role}:'")


def _rows_put_in(path: str) -> str:
    """SQL of the four states after rows that may be put in, from columns v0 to v3."""
    u = ", ".join(_new(f"v{s}", "user") for s in (0, 1, 3))
    return f"SELECT *, list_min([v3, {_new('w2', 'assistant')}]) AS w3 FROM (SELECT *, list_min([v2, {u}]) AS w2 FROM {path})"


_KEEP = lambda p: _put(p, "broken", "K", "role || ':' || text")
_FIT = lambda p, role: _put(p, "2 + broken", "R", f"'{role}:' || text")
_GONE = lambda p: _put(p, "3", "D", None)
_IF = lambda initial, path: f"CASE WHEN NOT gone AND ini = '{initial}' THEN {_KEEP(path)} END"
_ROLE = lambda role, path: f"CASE WHEN NOT gone THEN {_FIT(path, role)} END"
_SEEN = r"[^\x20\x09-\x0D]"
# edits are found from the first row on here, by comparing costs and letters; each path carries its lines
SQL = rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS UINTEGER), list_transform(range(8), lambda k: CAST(0 AS UINTEGER))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END)) AS tab),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crc AS (SELECT name, xor(CAST(4294967295 AS UINTEGER), list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS UINTEGER))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) % 20 AS k FROM (SELECT DISTINCT name FROM src), bits),
harmed AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src JOIN crc USING (name) WHERE k <> 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM harmed),
judged AS (SELECT *, substr(role, 1, 1) AS ini, NOT regexp_matches(text, '{_SEEN}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) || substr(role, 1, 1) AS pair FROM nth),
r AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS broken FROM judged),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS v1, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS v2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR[])) AS v3 FROM r
  UNION ALL
  SELECT conv_id, n, {_GONE('v0')}, list_min([{_GONE('v1')}, {_IF('s', 'v0')}]),
    list_min([{_GONE('w2')}, {_IF('u', 'v0')}, {_IF('u', 'v1')}, {_IF('u', 'w3')}, {_ROLE('user', 'v0')}, {_ROLE('user', 'v1')}, {_ROLE('user', 'w3')}]), list_min([{_GONE('w3')}, {_IF('a', 'w2')}, {_ROLE('assistant', 'w2')}])
  FROM ({_rows_put_in('(SELECT dp.conv_id, r.n, v0, v1, v2, v3, role, text, ini, gone, broken FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n + 1)')})),
ends AS (SELECT conv_id, list_min([v0, w3]) AS best FROM ({_rows_put_in('(SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)')})),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, sum(broken) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def damage(rows: DataFrame) -> DataFrame:
    """The rows with one harm in four, chosen by the check sum of conversation and turn; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.col("k")
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("k"))
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every damaged conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repair_conversations(damage(rows))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = rows.select("conv_id").distinct().alias("o").join(done.report.alias("r"), same("o", "r"), "left").join(digest_lines(done.rows).alias("d"), same("o", "d"), "left")
    counts = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *counts, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.lit(_EMPTY)).alias("repaired_sha256"))
