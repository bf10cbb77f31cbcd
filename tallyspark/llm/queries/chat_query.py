from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.chat import format_chats, masked_text

_SAME = "</s>[INST] ok [/INST]"
_CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "[:]", "[=]")
_ANY = " OR ".join(f"contains(role, '{c}') OR contains(text, '{c}')" for c in _CONTROLS)
_SIZE = "length(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'))"
# lengths of the written form by arithmetic: turns that hold a control string are escaped
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAME}'), (-7, 1, 'assistant', '{_SAME}')),
t AS (SELECT *, ({_ANY}) AS esc FROM c),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN 10 ELSE 16 END + CASE WHEN esc THEN {_SIZE.format('role')} + {_SIZE.format('text')} ELSE length(role) + length(text) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id
"""


@query("op9_chat_round_trip", SQL)
def op9_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every formatted conversation, and from one made of control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_SAME}'), (-7L, 1L, 'assistant', '{_SAME}') AS t(conv_id, turn, role, text)")
    chats = format_chats(rows.unionByName(odd))
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), back.alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", sha("back").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), "formatted_chars")
