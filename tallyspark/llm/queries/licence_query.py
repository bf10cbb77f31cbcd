from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.catalog import query
from tallyspark.llm.licences import DIGITS, TEMPLATES, VARIANTS, scan_licences, template_words

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_WORDS = r"[w FOR w IN regexp_split_to_array(lower(regexp_replace({0}, '(?im)^[^\p{{L}}\p{{N}}\n]*copyright\b[^\n]*$', '', 'g')), '[^\p{{L}}\p{{N}}]+') IF w <> '']"
_GRAMS = "[w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]"
_ONLY = lambda words: f"list_sort(list_distinct([x FOR x IN w IF x IN ({', '.join(map(_Q, words))})]))"
_END = r"\r\n|[\n\r]"
_MOST = int(1.5 * max(len(template_words(text)) for _, text in TEMPLATES)) + 2
SQL = f"""
WITH t0(template, licence, text) AS (VALUES {', '.join(f'({n}, {_Q(name)}, {_Q(text)})' for n, (name, text) in enumerate(TEMPLATES))}),
t1 AS (SELECT template, licence, {_WORDS.format('text')} AS w FROM t0),
t2 AS (SELECT template, licence, len(w) - 1 AS b, {_ONLY(VARIANTS)} AS variants, {_ONLY(DIGITS)} AS digits, unnest({_GRAMS}) AS g FROM t1 WHERE len(w) > 1),
t AS (SELECT template, licence, b, variants, digits, g, count(*) AS times FROM t2 GROUP BY ALL),
l0 AS (SELECT row_number() OVER () AS row, doc_id, regexp_split_to_array(text, '{_END}') AS lines FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l0), l2 AS (SELECT row, doc_id, i, {_WORDS.format('line')} AS w FROM l1),
k AS (SELECT list(DISTINCT g) AS known FROM t),
l AS (SELECT row, doc_id, i, w, len(w) < 2 OR 2 * len([x FOR x IN {_GRAMS} IF list_contains(known, x)]) >= len(w) - 1 AS alike FROM l2, k),
r AS (SELECT *, sum(CASE WHEN alike THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY i) AS run FROM l),
runs AS (SELECT row, doc_id, flatten(list(w ORDER BY i)) AS w FROM r WHERE alike GROUP BY row, doc_id, run HAVING sum(len(w)) BETWEEN 2 AND {_MOST}),
p AS (SELECT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '(?:\\r\\n|[\\n\\r])[ \\t]*(?:\\r\\n|[\\n\\r])+'))) AS passage FROM documents WHERE text IS NOT NULL),
w0 AS (SELECT doc_id, {_WORDS.format('passage')} AS w FROM p UNION ALL SELECT doc_id, w FROM l UNION ALL SELECT doc_id, w FROM runs),
w AS (SELECT DISTINCT doc_id, w FROM w0 WHERE len(w) BETWEEN 2 AND {_MOST}),
g0 AS (SELECT doc_id, array_to_string(w, ' ') AS passage, len(w) - 1 AS a, {_ONLY(VARIANTS)} AS has, {_ONLY(DIGITS)} AS numbers, unnest({_GRAMS}) AS g FROM w),
g AS (SELECT doc_id, passage, a, has, numbers, g, count(*) AS mine FROM g0 GROUP BY ALL),
d AS (SELECT doc_id, passage, licence, 2 * sum(least(mine, times)) / (a + b) AS dice FROM g JOIN t USING (g) WHERE has = variants AND list_has_all(numbers, digits) GROUP BY doc_id, passage, a, template, licence, b),
best AS (SELECT doc_id, passage, licence, dice FROM d WHERE dice >= 0.8 - 1e-9 QUALIFY dice >= max(dice) OVER (PARTITION BY doc_id, passage) - 1e-9)
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(DISTINCT passage) AS passages FROM best GROUP BY doc_id, licence
"""


@query("op6_licence_scan", SQL)
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that each document states, with the best Dice coefficient."""
    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "licence", F.round("dice", 6).alias("dice"), "passages")
