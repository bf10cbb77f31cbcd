"""Privacy scans, text audits, integrity and consistency checks, claim tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import audit as A
from tallyspark.operators import quality as Q
from tallyspark.operators import report as R
from tallyspark.operators import screening as G
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded
from tallyspark.plans.screening_queries import EPISODES, RULES, entries

# ---------------------------------------------------------------- personal data in cells


def contacts(spark, d):
    """Customers with contact columns made from their keys; some of the numbers pass a checksum by chance."""
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(
        F.col("c_name").alias("customer_name"), F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com"))).otherwise("none").alias("mail"),
        F.when(k % 4 == 0, F.concat(F.lit("+36 30 "), (k + 1000000).cast("string"))).otherwise((k + 0.5).cast("string")).alias("tel"),
        (k * 7919 + 10000000000).cast("string").alias("id11"), (k * 104729 + 8000000000).cast("string").alias("id10"), (k * 15485863 + 4000000000000000).cast("string").alias("card"),
        F.concat(F.lit("HU"), F.lpad(((k * 13) % 98 + 1).cast("string"), 2, "0"), F.lpad(k.cast("string"), 24, "1")).alias("account"))


def _digit(c, i):
    return f"CAST(substr({c}, {i}, 1) AS INTEGER)"


# the rules of the checksums, on cells that are digits alone: 11 for a TCKN, 10 beginning with 8 for a tax ID, 13 to 19 for a card
_TCKN = f"CASE WHEN length(v) = 11 AND v[1] <> '0' THEN ((7 * ({' + '.join(_digit('v', i) for i in (1, 3, 5, 7, 9))}) - ({' + '.join(_digit('v', i) for i in (2, 4, 6, 8))})) % 10 + 10) % 10 = {_digit('v', 10)} AND ({' + '.join(_digit('v', i) for i in range(1, 11))}) % 10 = {_digit('v', 11)} END"
_HU = f"CASE WHEN length(v) = 10 AND v[1] = '8' THEN ({' + '.join(f'{_digit('v', i)} * {i}' for i in range(1, 10))}) % 11 = {_digit('v', 10)} END"
_LUHN = "CASE WHEN length(v) BETWEEN 13 AND 19 THEN list_sum([CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i] AS INTEGER) WHEN v[i] > '4' THEN CAST(v[i] AS INTEGER) * 2 - 9 ELSE CAST(v[i] AS INTEGER) * 2 END FOR i IN range(1, length(v) + 1)]) % 10 = 0 END"
_IBAN_NUM = "CAST(substr(v, 5) || '1730' || substr(v, 3, 2) AS HUGEINT) % 97 = 1"


# a number grows out of its kind with the keys, so every rule is put to every column of digits
@query("personal_data_scan", f"""WITH c AS (SELECT c_custkey AS k FROM customer), n AS (SELECT 'id11' AS "column", CAST(k * 7919 + 10000000000 AS VARCHAR) AS v FROM c
  UNION ALL SELECT 'id10', CAST(k * 104729 + 8000000000 AS VARCHAR) FROM c UNION ALL SELECT 'card', CAST(k * 15485863 + 4000000000000000 AS VARCHAR) FROM c), f AS (SELECT 'mail' AS "column", 'e-mail address' AS kind, count(*) FILTER (k % 3 = 0) AS count FROM c
  UNION ALL SELECT 'tel', 'phone number', count(*) FILTER (k % 4 = 0) FROM c
  UNION ALL SELECT "column", 'Turkish ID number (TCKN)', count(*) FILTER ({_TCKN}) FROM n GROUP BY 1
  UNION ALL SELECT "column", 'Hungarian tax ID', count(*) FILTER ({_HU}) FROM n GROUP BY 1
  UNION ALL SELECT "column", 'payment card number', count(*) FILTER ({_LUHN}) FROM n GROUP BY 1
  UNION ALL SELECT 'account', 'bank account (IBAN)', count(*) FILTER ({_IBAN_NUM}) FROM (SELECT 'HU' || lpad(CAST((k * 13) % 98 + 1 AS VARCHAR), 2, '0') || lpad(CAST(k AS VARCHAR), 24, '1') AS v FROM c)
  UNION ALL SELECT 'customer_name', 'names or identifiers (column name and content)', count(*) FROM customer) SELECT * FROM f WHERE count > 0""")
def personal_data_scan(spark, d):
    return A.personal_data_scan(contacts(spark, d))


@query("personal_data_scan_documents")
def personal_data_scan_documents(spark, d):
    return A.personal_data_scan(A.split_units(V.documents(spark, d), "doc_id", "text"), "text")


# ---------------------------------------------------------------- text audit
WORDING_RULES = [
    {"id": "W1", "severity": "HIGH", "pattern": r"\bthe\s+and\b", "issue": "doubled connective", "current": "choose one"},
    {"id": "W2", "pattern": r"\bcopyright\b|\blicen[sc]e\b", "issue": "licence wording", "current": "remove"},
]
_UNITS = "u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)"


@query("text_audit_email", f"WITH {_UNITS}, f AS (SELECT CAST(doc_id AS VARCHAR) AS file, sum(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))) AS n FROM u GROUP BY 1) SELECT file, CAST(n AS BIGINT) AS n FROM f WHERE n > 0")
def text_audit_email(spark, d):
    f = A.text_audit(A.split_units(V.documents(spark, d), "doc_id", "text"))["findings"]
    return f.where("finding = 'e-mail address'").groupBy("file").agg(F.sum("count").alias("n"))


@query("text_audit_wording", f"""WITH {_UNITS}, h AS (SELECT doc_id, 'doubled connective' AS finding, len(regexp_extract_all(t, '(?i)\\bthe\\s+and\\b')) AS n FROM u
   UNION ALL SELECT doc_id, 'licence wording', len(regexp_extract_all(t, '(?i)\\bcopyright\\b|\\blicen[sc]e\\b')) FROM u)
  SELECT CAST(doc_id AS VARCHAR) AS file, finding, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1, 2 HAVING sum(n) > 0""")
def text_audit_wording(spark, d):
    f = A.text_audit(A.split_units(V.documents(spark, d), "doc_id", "text"), WORDING_RULES)["findings"]
    return f.where("check = 'outdated wording'").groupBy("file", "finding").agg(F.sum("count").alias("n"))


@query("text_audit_units", f"WITH {_UNITS} SELECT CAST(doc_id AS VARCHAR) AS file, count(*) FILTER (trim(t) <> '') AS units FROM u GROUP BY 1")
def text_audit_units(spark, d):
    return A.text_audit(A.split_units(V.documents(spark, d), "doc_id", "text"))["summary"].select("file", "units")


@query("text_audit_kinds")
def text_audit_kinds(spark, d):
    f = A.text_audit(A.split_units(V.documents(spark, d), "doc_id", "text"), WORDING_RULES, names=["Enerth Inion"])["findings"]
    return f.groupBy("check", "finding", "severity").agg(F.sum("count").alias("n"))


# the list grows with the table: the first two words of every document, of ASCII letters and different from each other
@query("text_audit_names", f"""WITH {_UNITS}, n AS (SELECT DISTINCT lower(x) AS name FROM (SELECT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') AS x FROM documents) WHERE x <> '' AND lower(split_part(x, ' ', 1)) <> lower(split_part(x, ' ', 2))),
  w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(t, '(?i)https?://\\S+|\\bdoi:\\s*\\S+|\\b10\\.\\d{{4,9}}/\\S+|\\bISBN[\\s:-]*[\\dXx-]{{10,17}}', ' ', 'g')), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS w FROM u),
  g AS (SELECT doc_id, unnest([w[i] || w[i + 1] || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS name FROM w)
  SELECT CAST(doc_id AS VARCHAR) AS file, count(*) AS n FROM g JOIN n USING (name) GROUP BY 1""")
def text_audit_names(spark, d):
    docs = V.documents(spark, d)
    two = F.split(F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+", 0)), " ")
    names = docs.where(F.size(two) == 2).where(two[0] != two[1]).select(F.array_join(two, " ").alias("name"))
    f = A.text_audit(A.split_units(docs, "doc_id", "text"), names=names)["findings"]
    return f.where("finding = 'listed name'").groupBy("file").agg(F.sum("count").alias("n"))


@query("claim_registry_audit", """SELECT doc_id, id, required, found AS expected_found, hits AS forbidden_hits, CASE WHEN (found OR NOT required) AND hits = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT doc_id, 'N' AS id, true AS required, contains(text, 'the ') AS found, CAST(contains(text, 'haha') AS INTEGER) + CAST(contains(text, 'lorem') AS INTEGER) AS hits FROM documents
  UNION ALL SELECT doc_id, 'M', false, contains(text, 'and'), CAST(contains(text, 'le ') AS INTEGER) FROM documents)""")
def claim_registry_audit(spark, d):
    return A.claim_registry_audit(V.table(spark, d, "documents"), [{"id": "N", "expected": "the ", "forbidden": ["haha", "lorem"]}, {"id": "M", "expected": "and", "required": False, "forbidden": ["le "]}])


# ---------------------------------------------------------------- references
def references(spark, d):
    """Parts as the registry, with titles of seven words; every part is also supplied, with a letter removed from none to seven words of its title and half of the DOIs blank."""
    p = V.table(spark, d, "part")
    k = F.col("p_partkey")
    mark = F.md5(k.cast("string").cast("binary"))
    title = F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("no"), k), F.substring(mark, 1, 8), F.substring(mark, 9, 5), F.substring(mark, 14, 9))
    doi = F.concat(F.lit("10.1000/p"), k)
    reg = p.select(doi.alias("doi"), title.alias("title"), (F.col("p_size") + 1970).alias("year"), F.lit("Smith").alias("first_author"), F.col("p_brand").alias("journal"))
    misspelt = F.array_join(F.transform(F.split(title, " "), lambda w, i: F.when(i < F.floor(k / 2) % 8, F.concat(F.substring(w, 1, 1), F.substr(w, F.lit(3)))).otherwise(w)), " ")
    sup = p.select(k.alias("ref"), F.when(k % 2 == 1, F.concat(F.lit("https://doi.org/"), F.when(k % 20 == 5, "10.1000/none").otherwise(doi), F.lit("."))).otherwise("").alias("doi"),
                   misspelt.alias("title"), (F.col("p_size") + 1970 + F.when(k % 9 == 0, 3).otherwise(0)).alias("year"),
                   F.when(k % 7 == 0, "Jones, A.").otherwise("J. Smith, B. Doe").alias("authors"), F.col("p_brand").alias("journal"))
    return sup, reg


# every supplied title without a DOI against every registered one: nothing is blocked on this side
@query("match_references", """WITH t AS (SELECT p_partkey AS k, p_brand, p_size + 1970 AS year, concat_ws(' ', p_name, p_type, 'no' || p_partkey, substr(md5(p_partkey::VARCHAR), 1, 8), substr(md5(p_partkey::VARCHAR), 9, 5), substr(md5(p_partkey::VARCHAR), 14, 9)) AS title FROM part),
  g AS (SELECT k, '10.1000/p' || k AS doi, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS rt, year FROM t),
  s AS (SELECT k AS ref, k % 2 = 1 AS has_doi, k % 20 = 5 AS lost, k % 7 = 0 AS a, year + CASE WHEN k % 9 = 0 THEN 3 ELSE 0 END AS year,
    trim(regexp_replace(lower(array_to_string(list_transform(string_split(title, ' '), lambda w, i: CASE WHEN i <= (k // 2) % 8 THEN substr(w, 1, 1) || substr(w, 3) ELSE w END), ' ')), '[^a-z0-9]+', ' ', 'g')) AS st FROM t),
  c AS (SELECT ref, doi, g.year AS gy, 1 - levenshtein(st, rt)::DOUBLE / greatest(length(st), length(rt)) AS sim, 1 - levenshtein(st, rt)::DOUBLE / greatest(length(st), length(rt)) + CASE WHEN s.year = g.year THEN 0.10::DOUBLE ELSE 0 END AS score FROM s, g WHERE NOT has_doi),
  best AS (SELECT ref, doi, gy, sim FROM c WHERE sim >= 0.85 QUALIFY row_number() OVER (PARTITION BY ref ORDER BY score DESC, doi DESC) = 1),
  m AS (SELECT s.ref, has_doi, lost, a, CASE WHEN has_doi THEN '10.1000/p' || s.ref ELSE doi END AS doi, abs(s.year - CASE WHEN has_doi THEN (SELECT year FROM g WHERE g.k = s.ref) ELSE gy END) > 1 AS y,
    CASE WHEN has_doi THEN 1 - levenshtein(st, (SELECT rt FROM g WHERE g.k = s.ref))::DOUBLE / greatest(length(st), length((SELECT rt FROM g WHERE g.k = s.ref))) ELSE 1 END < 0.80 AS t FROM s LEFT JOIN best USING (ref))
  SELECT ref, CASE WHEN (has_doi AND lost) OR doi IS NULL THEN 'NOT_FOUND' WHEN has_doi THEN CASE WHEN y OR a OR t THEN 'PARTIAL' ELSE 'VERIFIED' END ELSE 'MATCH_FOUND' END AS status,
   CASE WHEN has_doi AND lost THEN NULL ELSE doi END AS found_doi, CASE WHEN (has_doi AND lost) OR doi IS NULL THEN NULL ELSE concat_ws('; ', CASE WHEN t THEN 'title' END, CASE WHEN y THEN 'year' END, CASE WHEN a THEN 'first author' END) END AS disagreements FROM m""")
def match_references(spark, d):
    return A.match_references(*references(spark, d)).select("ref", "status", "found_doi", "disagreements")


# ---------------------------------------------------------------- safeguards
@query("k_anonymity", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) < 12")
def k_anonymity(spark, d):
    return A.k_anonymity(V.table(spark, d, "customer"), "c_nationkey,c_mktsegment", 12)


def _cells(spark, d):
    return V.table(spark, d, "documents").groupBy(F.concat_ws("/", "source", "lang").alias("cell")).agg(F.count(F.lit(1)).alias("documents"))


@query("suppress_small_cells", "SELECT source || '/' || lang AS cell, CASE WHEN count(*) < 3 THEN '<3' ELSE CAST(count(*) AS VARCHAR) END AS documents FROM documents GROUP BY 1")
def suppress_small_cells(spark, d):
    return A.suppress_small_cells(_cells(spark, d), "08_sources")[0]


@query("suppression_manifest", """SELECT '08_sources' AS "table", 'documents' AS "column", source || '/' || lang AS "row" FROM documents GROUP BY 3 HAVING count(*) < 3""")
def suppression_manifest(spark, d):
    return A.suppress_small_cells(_cells(spark, d), "08_sources")[1]


@query("leaked_codes", "SELECT DISTINCT 'C' || c_custkey AS code FROM customer WHERE c_custkey % 100 = 0 UNION SELECT DISTINCT 'EP-' || c_custkey FROM customer WHERE c_custkey % 250 = 0")
def leaked_codes(spark, d):
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    t = c.select(F.when(k % 100 == 0, F.concat(F.lit("see C"), k.cast("string"), F.lit(", page 2"))).otherwise(F.concat(F.lit("XC"), k.cast("string"))).alias("remark"),
                 F.when(k % 250 == 0, F.concat(F.lit("(EP-"), k.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("EP "), k.cast("string"))).alias("other"))
    codes = c.select(F.concat(F.lit("C"), k.cast("string")).alias("episode")).unionByName(c.select(F.concat(F.lit("EP-"), k.cast("string")).alias("episode")))
    return A.leaked_codes({"t": t}, codes)


def _edited(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    return o, o.where(k % 50 != 7).withColumn("o_orderstatus", F.when(k % 40 == 3, "X").otherwise(F.col("o_orderstatus"))).unionByName(
        o.where(k % 60 == 1).withColumn("o_orderkey", k + 100000000))


@query("snapshot_verify", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 50 = 7 THEN 'missing' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 50 = 7 OR o_orderkey % 40 = 3
  UNION ALL SELECT o_orderkey + 100000000, 'added' FROM orders WHERE o_orderkey % 60 = 1""")
def snapshot_verify(spark, d):
    before, after = _edited(spark, d)
    return A.snapshot_verify(after, "o_orderkey", A.snapshot_hashes(before, "o_orderkey"))


@query("units_in_one_only", """SELECT CAST(o_orderkey AS VARCHAR) AS unit, 'first' AS only_in FROM orders WHERE o_orderkey % 50 = 7 UNION ALL SELECT CAST(o_orderkey + 100000000 AS VARCHAR), 'second' FROM orders WHERE o_orderkey % 60 = 1""")
def units_in_one_only(spark, d):
    return A.units_in_one_only(*_edited(spark, d), "o_orderkey")


@query("aligned_cells", """SELECT CAST(o_orderkey AS VARCHAR) AS unit, 'o_orderstatus' AS "column", o_orderstatus AS first, CASE WHEN o_orderkey % 40 = 3 THEN 'X' ELSE o_orderstatus END AS second FROM orders WHERE o_orderkey % 50 <> 7
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 <> 7""")
def aligned_cells(spark, d):
    return A.aligned_cells(*_edited(spark, d), "o_orderkey", "o_orderstatus,o_custkey")


@query("compare_tables", """SELECT o_orderkey, o_orderstatus AS first, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 40 = 3 THEN 'X' ELSE o_orderstatus END AS second, o_orderkey % 50 = 7 OR o_orderkey % 40 = 3 AS changed FROM orders
  UNION ALL SELECT o_orderkey + 100000000, NULL, o_orderstatus, true FROM orders WHERE o_orderkey % 60 = 1""")
def compare_tables(spark, d):
    return A.compare_tables(*_edited(spark, d), "o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------- integrity and consistency
@query("integrity", """SELECT CASE WHEN n > 0 THEN level ELSE 'PASS' END AS level, "check", "where", n FROM (
  SELECT 'FAIL' AS level, 'o_orderkey unique' AS "check", 'orders' AS "where", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n
  UNION ALL SELECT 'FAIL', 'l_orderkey unique', 'lineitem', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'FAIL', 'labels refer to documents', 'labels', (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
  UNION ALL SELECT 'WARN', 'documents have a label', 'documents', (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
  UNION ALL SELECT 'FAIL', 'o_orderstatus outside the list', 'orders', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))
  UNION ALL SELECT 'FAIL', 'urgent orders have a cleared status', 'orders', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
  UNION ALL SELECT 'FAIL', 'no negative price', 'orders', (SELECT count(*) FROM orders WHERE o_totalprice < 0))""")
def integrity(spark, d):
    return Q.integrity(_integrity_checks(spark, d))


def _integrity_checks(spark, d):
    t = lambda n: V.table(spark, d, n)
    o = t("orders").withColumn("cleared", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(" "))
    return [
        Q.check_unique(o, "o_orderkey", "orders"), Q.check_unique(t("lineitem"), "l_orderkey", "lineitem"),
        Q.check_reference(t("labels"), "doc_id", t("documents"), "doc_id", "labels refer to documents", "labels"),
        Q.check_reference(t("documents"), "doc_id", t("labels"), "doc_id", "documents have a label", "documents", "WARN"),
        Q.check_allowed(o, "o_orderstatus", ["O", "F"], "orders", "o_orderkey"),
        Q.check_required(o, F.col("o_orderpriority") == "1-URGENT", ["cleared"], "urgent orders have a cleared status", "orders", "o_orderkey"),
        Q.check_condition(o, F.col("o_totalprice") < 0, "no negative price", "orders", "o_orderkey")]


@query("integrity_offenders", """SELECT 'FAIL' AS level, 'o_orderstatus outside the list' AS "check", 'orders' AS "where", CAST(o_orderkey AS VARCHAR) AS unit FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT 'FAIL', 'urgent orders have a cleared status', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
  UNION ALL SELECT 'FAIL', 'no negative price', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice < 0
  UNION ALL SELECT 'FAIL', 'o_orderkey unique', 'orders', CAST(o_orderkey AS VARCHAR) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
  UNION ALL SELECT 'FAIL', 'l_orderkey unique', 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'FAIL', 'labels refer to documents', 'labels', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT DISTINCT 'WARN', 'documents have a label', 'documents', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def integrity_offenders(spark, d):
    return Q.offenders(_integrity_checks(spark, d))


@query("money_bands", """WITH a AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderstatus = 'O' THEN o_totalprice * 40 END AS v FROM orders),
  b(position, band, lo, hi) AS (VALUES (0, '< 200k', 0, 200000), (1, '200k–1M', 200000, 1000000), (2, '1M–5M', 1000000, 5000000), (3, '≥ 5M', 5000000, 1e18)) SELECT position, band, count(v) AS documents FROM b LEFT JOIN a ON v >= lo AND v < hi GROUP BY 1, 2""")
def money_bands(spark, d):
    o = V.table(spark, d, "orders").select("o_totalprice", F.when(F.col("o_orderstatus") == "F", "HUF").otherwise("EUR").alias("cur"), F.when(F.col("o_orderstatus") == "O", 40.0).alias("rate"))
    return Q.money_bands(o, "o_totalprice", "cur", "rate")


@query("source_kind", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'system' WHEN '2-HIGH' THEN 'manual' WHEN '3-MEDIUM' THEN 'pending' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'other' END AS kind FROM orders""")
def source_kind(spark, d):
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", "System, external").when(p == "2-HIGH", "Standard document").when(p == "3-MEDIUM", "system (PENDING)").when(p == "4-NOT SPECIFIED", " ").otherwise("hearsay")
    return V.table(spark, d, "orders").select("o_orderkey", G.source_kind(raw).alias("kind"))


def _claim_rows(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda vals, m: F.element_at(F.array(*[F.lit(v) for v in vals]), (k / m % len(vals)).cast("int") + 1)
    return o.select(k.cast("string").alias("episode"), F.when(F.col("o_orderstatus") == "F", "Level 3").when(F.col("o_orderstatus") == "O", "Level 2 (pending evidence at L3)").otherwise(pick(["Level 1", "Below Level 1"], 1)).alias("level"),
                    pick(["", "Finance-binding", "Non-binding", "Indeterminate"], 1).alias("recorded_verdict"), pick(["Yes", "No", "Yes"], 4).alias("recorded_sign"), pick(["Rejected", "Not rejected", "Rejected", ""], 12).alias("rival"),
                    pick(["A", "B", "C"], 48).alias("window_tier"), pick(["Buyer", "Seller", "Buyer"], 144).alias("window_setter"), pick(["Yes", "No", "Yes"], 432).alias("independent"))


_CLAIM = """c AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'Level 3' WHEN 'O' THEN 'Level 2 (pending evidence at L3)' ELSE ['Level 1', 'Below Level 1'][CAST(k0 % 2 AS INTEGER) + 1] END AS level, ['', 'Finance-binding', 'Non-binding', 'Indeterminate'][CAST(k0 % 4 AS INTEGER) + 1] AS rv,
  ['Yes', 'No', 'Yes'][CAST(k0 // 4 % 3 AS INTEGER) + 1] AS sg, ['Rejected', 'Not rejected', 'Rejected', ''][CAST(k0 // 12 % 4 AS INTEGER) + 1] AS rival, ['A', 'B', 'C'][CAST(k0 // 48 % 3 AS INTEGER) + 1] AS wt, ['Buyer', 'Seller', 'Buyer'][CAST(k0 // 144 % 3 AS INTEGER) + 1] AS ws,
  ['Yes', 'No', 'Yes'][CAST(k0 // 432 % 3 AS INTEGER) + 1] AS ind FROM (SELECT *, o_orderkey AS k0 FROM orders)),
  e AS (SELECT *, CASE WHEN rv = '' AND level = 'Level 3' AND k % 8 = 0 THEN 'Non-binding' ELSE rv END AS v, CASE WHEN rv = '' AND level = 'Level 3' AND k % 8 = 0 THEN 'Yes' ELSE sg END AS s FROM c),
  b AS (SELECT *, CASE WHEN rival = 'Not rejected' THEN 'C' WHEN rival = 'Rejected' AND s = 'Yes' AND ind = 'Yes' AND wt = 'A' AND ws <> 'Seller' THEN 'A' WHEN rival = 'Rejected' AND s = 'Yes' AND ind = 'Yes' AND (wt = 'B' OR ws = 'Seller') THEN 'B' ELSE 'PENDING' END AS base FROM e),
  t AS (SELECT *, CASE WHEN level = 'Level 3' THEN CASE WHEN v = '' THEN 'PENDING' WHEN v = 'Indeterminate' OR s = 'No' THEN 'X' WHEN v = 'Non-binding' AND base <> 'PENDING' THEN base || '¬' ELSE base END WHEN level LIKE 'Level 2%' THEN 'D' WHEN level LIKE 'Level 1%' THEN 'E' ELSE '—' END AS tier FROM b)"""


@query("claim_tiers", f"""WITH {_CLAIM}, w(claim_tier, wording) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in R.WORDING.items())})
  SELECT CAST(k AS VARCHAR) AS episode, level, v AS verdict, CASE WHEN rv = '' AND level = 'Level 3' AND k % 8 = 0 THEN 'computed' WHEN rv <> '' THEN 'recorded' ELSE '' END AS verdict_source, tier AS claim_tier, wording AS permitted_wording FROM t JOIN w ON claim_tier = tier""")
def claim_tiers(spark, d):
    rows = _claim_rows(spark, d)
    v = rows.where(F.col("episode").cast("long") % 8 == 0).select("episode", F.lit("Non-binding").alias("verdict"), F.lit("Yes").alias("sign_stable"), F.lit("").alias("indeterminate_reason"))
    return R.claims(rows, v)


_FIELDS = [{"column": "stop_point", "allowed": ["Other", "Deferred", "N/A", "PENDING"], "required_when": "level = 'Below Level 1'"}, {"column": "buyer", "allowed": ["Existing business", "New venture"]}]


def _described(spark, d):
    r = _claim_rows(spark, d)
    k = F.col("episode").cast("long")
    return r.select("episode", "level", F.element_at(F.array(*[F.lit(x) for x in ("other", "", "N/A", "nonsense", "PENDING")]), (k % 5 + 1).cast("int")).alias("stop_point"),
                    F.element_at(F.array(*[F.lit(x) for x in ("existing-business", "", "New  venture")]), (k % 3 + 1).cast("int")).alias("buyer"))


@query("descriptive_fields", f"""WITH {_CLAIM}, f AS (SELECT 'stop_point' AS field, ['Other', '', 'N/A', 'invalid value', 'PENDING'][k % 5 + 1] AS v, level = 'Below Level 1' AS req FROM c UNION ALL SELECT 'buyer', ['Existing business', '', 'New venture'][k % 3 + 1], false FROM c)
  SELECT field, CASE WHEN v = '' THEN 'blank' ELSE v END AS value, count(*) AS episodes FROM f WHERE req OR v NOT IN ('', 'N/A') GROUP BY 1, 2""")
def descriptive_fields(spark, d):
    return Q.descriptive_fields(_described(spark, d), _FIELDS)["counts"]


@query("descriptive_checks", f"""WITH {_CLAIM}, f AS (SELECT 'stop_point' AS field, ['Other', '', 'N/A', 'invalid value', 'PENDING'][k % 5 + 1] AS v, level = 'Below Level 1' AS req FROM c UNION ALL SELECT 'buyer', ['Existing business', '', 'New venture'][k % 3 + 1], false FROM c),
  g AS (SELECT field, 'value not in the allowed list' AS "check", count(*) FILTER (v = 'invalid value') AS n, 'FAIL' AS l FROM f GROUP BY 1 UNION ALL SELECT field, 'required but blank or PENDING', count(*) FILTER (req AND v IN ('', 'PENDING')), 'WARN' FROM f GROUP BY 1)
  SELECT field, "check", n, CASE WHEN n > 0 THEN l ELSE 'PASS' END AS level FROM g""")
def descriptive_checks(spark, d):
    return Q.descriptive_fields(_described(spark, d), _FIELDS)["checks"]


@query("temporal_ladder", f"""WITH {EPISODES}, u AS (SELECT unnest(['solvent', 'documents']) AS step, unnest([solvent, doc_ok]) AS v FROM v_ep WHERE s0 = 'Pass')
  SELECT step, count(*) FILTER (v IN ('Yes', 'COMPLETE')) AS yes, count(*) FILTER (v = 'No') AS no, count(*) FILTER (v NOT IN ('Yes', 'COMPLETE', 'No')) AS open, count(*) AS of_analysable FROM u GROUP BY 1""")
def temporal_ladder(spark, d):
    return Q.temporal_ladder(G.apply_gates(entries(spark, d), RULES)["episodes"], {"solvent": "solvent", "doc_ok": "documents"})


def _verdict_rows(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("episode"), F.when(F.col("o_orderstatus") == "F", "Finance-binding").otherwise("Non-binding").alias("verdict"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").when(F.col("o_orderpriority") == "2-HIGH", "Not computable").otherwise("No").alias("finance_actionable"), F.when(F.col("o_totalprice") < 100000, "Yes").otherwise("No").alias("fragile"))


@query("finance_ladder", f"""WITH {EPISODES} SELECT position, claim, episodes FROM (SELECT 0 AS position, 'financing observed' AS claim, (SELECT count(*) FROM v_ep WHERE s0 = 'Pass' AND doc_ok = 'Yes') AS episodes
  UNION ALL SELECT 1, 'temporally actionable', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT 2, 'actionability not computable', (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH')
  UNION ALL SELECT 3, 'finance-binding', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 4, 'of which fragile', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000))""")
def finance_ladder(spark, d):
    return Q.finance_ladder(G.apply_gates(entries(spark, d), RULES)["episodes"], "doc_ok", _verdict_rows(spark, d))


def _pipeline_tables(spark, d):
    s = V.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    flag = lambda m: F.when(k % m == 0, "No").otherwise("Yes")
    reg = s.select(F.col("s_name").alias("source"), flag(7).alias("unique"), flag(5).alias("in_window"), flag(3).alias("cleared"))
    log = V.table(spark, d, "lineitem").where("l_discount > 0.09").join(s, F.col("l_suppkey") == k).select(F.col("s_name").alias("source"))
    cand = V.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("candidate"), F.element_at(F.array(*[F.lit(x) for x in ("Retained", "Merged", "Not admitted", "")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("decision"))
    return reg, log, cand


@query("pipeline_counts", f"""WITH {EPISODES}, r AS (SELECT *, s_suppkey % 7 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 AS an FROM supplier), x AS (SELECT 0 AS position, 'records registered' AS stage, (SELECT count(*) FROM r) AS n UNION ALL SELECT 1, 'unique records', (SELECT count(*) FROM r WHERE s_suppkey % 7 > 0)
  UNION ALL SELECT 2, 'analytic sources', (SELECT count(*) FROM r WHERE an) UNION ALL SELECT 3, 'analytic sources searched', (SELECT count(*) FROM r WHERE an AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)) UNION ALL SELECT 4, 'candidates', (SELECT count(*) FROM customer)
  UNION ALL SELECT 5, 'retained', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) UNION ALL SELECT 6, 'merged', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 1) UNION ALL SELECT 7, 'not admitted', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 2)
  UNION ALL SELECT 8, 'episodes screened', (SELECT count(*) FROM v_ep)) SELECT * FROM x UNION ALL SELECT 9, level, count(*) FROM v_ep GROUP BY 2""")
def pipeline_counts(spark, d):
    return Q.pipeline_counts(*_pipeline_tables(spark, d), G.apply_gates(entries(spark, d), RULES)["episodes"])


_CONSISTENCY = f"""{EPISODES}, e AS (SELECT episode, level, CASE WHEN k % 3 = 0 THEN 'Finance-binding' ELSE '' END AS recorded, CASE WHEN k % 5 > 0 THEN 'Rejected' ELSE '' END AS rival, solvent, indep, k FROM v_ep),
  st AS (SELECT 'C' || o_custkey AS episode, l_linenumber AS i, l_returnflag AS f, CASE WHEN l_discount > 0 THEN l_quantity - 1 END AS days, l_tax > 0.05 AS zero FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  tl AS (SELECT DISTINCT episode FROM st), v AS (SELECT 'C' || o_custkey AS episode, max(CASE WHEN o_orderstatus = 'F' THEN 'Finance-binding' ELSE 'Non-binding' END) AS verdict, bool_or(o_totalprice < 100000) AS fragile,
    max(CASE o_orderpriority WHEN '1-URGENT' THEN 'Yes' WHEN '2-HIGH' THEN 'Not computable' ELSE 'No' END) AS act FROM orders GROUP BY 1),
  cand AS (SELECT 'C' || c_custkey AS episode, c_custkey % 4 AS d FROM customer), top AS (SELECT * FROM e WHERE level = 'Level 3'),
  bad AS (SELECT 'FAIL' AS level, 'Level-3 episode without a timeline' AS "check", 'timeline' AS "where", episode AS unit FROM top WHERE episode NOT IN (SELECT episode FROM tl)
   UNION ALL SELECT 'WARN', 'Timeline of an episode that is not Level 3', 'timeline', episode FROM tl WHERE episode NOT IN (SELECT episode FROM top)
   UNION ALL SELECT 'FAIL', 'Expected durations coded as documented but blank in the steps', 'steps', episode FROM e WHERE solvent = 'Yes' AND (level = 'Level 3' OR episode IN (SELECT episode FROM tl)) AND episode IN (SELECT episode FROM st WHERE days IS NULL)
   UNION ALL SELECT 'WARN', 'Expected duration of exactly 0 days', 'steps', episode FROM st WHERE days = 0
   UNION ALL SELECT 'FAIL', 'Recorded verdict differs from the computed one', 'episodes', episode FROM v JOIN e USING (episode) WHERE recorded <> '' AND recorded <> verdict
   UNION ALL SELECT 'WARN', 'Level-3 episode with no verdict recorded', 'episodes', episode FROM top WHERE recorded = ''
   UNION ALL SELECT 'WARN', 'Fragile verdict: decisive slack within one day of zero', 'verdicts', episode FROM v WHERE fragile
   UNION ALL SELECT 'WARN', 'Duration 0 without zero_documented = Yes (treated as missing)', 'steps', episode FROM st WHERE days = 0 AND NOT zero
   UNION ALL SELECT 'WARN', 'Finance actionability not computable', 'verdicts', episode FROM v WHERE act = 'Not computable'
   UNION ALL SELECT 'FAIL', 'Level-3 episode without a valid rival result', 'episodes', episode FROM top WHERE rival <> 'Rejected'
   UNION ALL SELECT 'WARN', 'Payment-type step coded on the finance clock', 'steps', episode FROM st WHERE i = 1 AND f = 'A'
   UNION ALL SELECT 'WARN', 'Readiness-type step not on the readiness clock', 'steps', episode FROM st WHERE i = 2 AND f = 'A'
   UNION ALL SELECT 'FAIL', 'Episode that is not retained in the candidate list', 'candidates', episode FROM e WHERE episode NOT IN (SELECT episode FROM cand WHERE d = 0)
   UNION ALL SELECT 'WARN', 'Retained candidate missing from the episodes', 'candidates', episode FROM cand WHERE d = 0 AND episode NOT IN (SELECT episode FROM e)
   UNION ALL SELECT 'WARN', 'Candidate without a decision', 'candidates', episode FROM cand WHERE d = 3
   UNION ALL SELECT 'WARN', 'Independence not met but source kind not coded', 'episodes', episode FROM e WHERE (level LIKE 'Level 2%' OR level LIKE 'Level 3%') AND indep <> 'Yes' AND k % 2 = 1
   UNION ALL SELECT 'WARN', 'Episode code does not look like a neutral pseudonym', 'episodes', episode FROM e),
  rules(level, "check", "where") AS (SELECT DISTINCT level, "check", "where" FROM bad)"""


@query("consistency_checks", f"""WITH {_CONSISTENCY} SELECT level, "check", "where", count(DISTINCT unit) AS n FROM bad GROUP BY 1, 2, 3""")
def consistency_checks(spark, d):
    return _consistency(spark, d).where("n > 0")


@query("consistency_offenders", f"""WITH {_CONSISTENCY} SELECT DISTINCT level, "check", "where", unit FROM bad""")
def consistency_offenders(spark, d):
    return _consistency(spark, d, "offenders")


@query("consistency_passes", f"""WITH {_CONSISTENCY} SELECT 17 - count(*) AS passed FROM rules""")
def consistency_passes(spark, d):
    return _consistency(spark, d).where("level = 'PASS' and n = 0").agg(F.count(F.lit(1)).alias("passed"))


def _consistency(spark, d, table="checks"):
    e = G.episode_levels(entries(spark, d), RULES)
    k = F.substr(F.col("episode"), F.lit(2)).cast("long")
    e = e.select("episode", "level", F.when(k % 3 == 0, "Finance-binding").otherwise("").alias("recorded_verdict"), F.when(k % 5 > 0, "Rejected").alias("rival"), "solvent", "indep", F.when(k % 2 == 0, "System").otherwise("").alias("source"))
    li = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    st = li.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("episode"), F.when(F.col("l_linenumber") == 1, "Payment made").when(F.col("l_linenumber") == 2, "Training").otherwise("other").alias("step"),
                   F.when(F.col("l_returnflag") == "A", "finance").otherwise("operational readiness").alias("clock"), F.when(F.col("l_discount") > 0, F.col("l_quantity") - 1).alias("expected_days"), F.when(F.col("l_tax") > 0.05, "Yes").alias("zero_documented"))
    v = _verdict_rows(spark, d).groupBy("episode").agg(F.max("verdict").alias("verdict"), F.max("fragile").alias("fragile"), F.max("finance_actionable").alias("finance_actionable"))
    _, _, cand = _pipeline_tables(spark, d)
    return Q.consistency_checks(e, v, None, st, cand, "episode", "solvent", "indep", "source")[table]


@query("status_summary", f"""WITH {_CONSISTENCY}, o AS (SELECT count(*) AS sources, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS held, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS pending FROM orders)
  SELECT o.*, (SELECT count(*) FROM v_ep) AS episodes, (SELECT count(*) FROM v_ep WHERE level LIKE 'Level 1%') AS level_1, (SELECT count(*) FROM v_ep WHERE level LIKE 'Level 2%') AS level_2, (SELECT count(*) FROM v_ep WHERE level LIKE 'Level 3%') AS level_3,
   (SELECT count(*) FROM v_ep WHERE level LIKE 'Held%') AS episodes_held, (SELECT count(*) FROM rules WHERE level = 'FAIL') AS fail, (SELECT count(*) FROM rules WHERE level = 'WARN') AS warn, CASE WHEN pending > 0 THEN 'A' ELSE 'B' END AS step FROM o""")
def status_summary(spark, d):
    src = V.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "Held").otherwise("PENDING").alias("status"))
    return Q.status_summary(G.apply_gates(entries(spark, d), RULES)["episodes"], src, _consistency(spark, d), frozen=False)


@query("lock_readiness")
def lock_readiness(spark, d):
    r = G.apply_gates(entries(spark, d), RULES)
    return Q.lock_readiness(RULES, r["episodes"], r["problems"], _consistency(spark, d), ["neutral pseudonym"]).groupBy("area").agg(F.count(F.lit(1)).alias("blockers"))


@query("data_dictionary", """SELECT 'customer' AS "table", 'c_mktsegment' AS field, 'string' AS type, count(c_mktsegment) AS non_missing, count(DISTINCT c_mktsegment) AS "distinct", '' AS allowed, '' AS meaning FROM customer
  UNION ALL SELECT 'customer', 'solvent', 'string', count(*), count(DISTINCT CASE WHEN c_acctbal < 0 THEN 'No' ELSE 'Yes' END), 'Yes | No | PENDING | Unknown | Held', 'Gate L3b' FROM customer""")
def data_dictionary(spark, d):
    c = V.table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") < 0, "No").otherwise("Yes").alias("solvent"))
    return Q.data_dictionary({"customer": c}, RULES)


# ---------------------------------------------------------------- agreement of two coded tables
def _two_coders(spark, d):
    r = V.doc_labels(spark, d)
    k = F.col("doc_id")
    yn = lambda c: F.when(c == 1, "Yes").otherwise("No")
    a = r.select(F.concat(F.lit("U"), k.cast("string")).alias("unit_id"), yn(F.col("quality")).alias("q"), F.when(k % 9 == 0, "").otherwise(yn(F.col("toxic"))).alias("t"))
    b = r.where(k % 11 != 0).select(F.concat(F.lit("u"), k.cast("string")).alias("unit_id"), F.when(k % 6 == 0, "No").otherwise(yn(F.col("quality"))).alias("q"), F.when(k % 8 == 0, "Yes").otherwise(yn(F.col("toxic"))).alias("t"))
    return a, b


@query("table_agreement", f"""WITH {V.DOC_LABELS}, m AS (SELECT doc_id AS k, CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END AS qa, CASE WHEN doc_id % 6 = 0 THEN 'No' WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS qb, CASE WHEN doc_id % 9 = 0 THEN 'Unknown' WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS ta,
   CASE WHEN doc_id % 8 = 0 THEN 'Yes' WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS tb FROM v_doc WHERE doc_id % 11 <> 0), l AS (SELECT 'q' AS c, qa AS x, qb AS y FROM m UNION ALL SELECT 't', ta, tb FROM m),
  cat(v) AS (VALUES ('Yes'), ('No'), ('Unknown')), n AS (SELECT c, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS po FROM l GROUP BY 1),
  p AS (SELECT c, v, (SELECT count(*) FROM l WHERE l.c = n.c AND x = v) / n AS px, (SELECT count(*) FROM l WHERE l.c = n.c AND y = v) / n AS py FROM n, cat), e AS (SELECT c, sum(px * py) AS pe, sum((px + py) / 2 * (1 - (px + py) / 2)) / 2 AS pg FROM p GROUP BY 1)
  SELECT c AS "column", CAST(n AS BIGINT) AS units, round(100 * po, 6) AS percent_agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pg) / (1 - pg), 6) AS ac1 FROM n JOIN e USING (c)""")
def table_agreement(spark, d):
    from tallyspark.operators.agreement import table_agreement as ta

    scale = ["Yes", "No", "Unknown"]
    return rounded(ta(*_two_coders(spark, d), "unit_id", "q,t", {"q": scale, "t": scale}, replicates=0)["agreement"])


@query("table_agreement_intervals")
def table_agreement_intervals(spark, d):
    from tallyspark.operators.agreement import table_agreement as ta

    return ta(*_two_coders(spark, d), "unit_id", "q,t")["agreement"]


@query("level_agreement", f"""WITH {EPISODES}, m AS (SELECT level AS u, CASE WHEN k % 10 = 0 THEN 'Level 1' ELSE level END AS v FROM v_ep) SELECT count(*) AS units, count(*) FILTER (u <> v) AS differing, count(*) FILTER (u = 'Level 3') AS top_first, count(*) FILTER (v = 'Level 3') AS top_second,
  count(*) FILTER (u = 'Level 3' AND v = 'Level 3') AS top_both, count(*) FILTER (u = 'Level 3' OR v = 'Level 3') AS top_either FROM m""")
def level_agreement(spark, d):
    from tallyspark.operators.agreement import level_agreement as la

    e = G.apply_gates(entries(spark, d), RULES)["episodes"].select("episode", "level")
    other = e.withColumn("level", F.when(F.substr(F.col("episode"), F.lit(2)).cast("long") % 10 == 0, "Level 1").otherwise(F.col("level")))
    return la(e, other, "episode").drop("kappa_linear")
