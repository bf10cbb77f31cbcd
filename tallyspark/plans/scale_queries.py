"""Scales, agreement, fuzzy sets and coded evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import agreement as A
from tallyspark.operators import coding as G
from tallyspark.operators import scales as S
from tallyspark.operators import sets as Z
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded

_Q = [f"q{i}" for i in range(1, 7)]
_SUM = " + ".join(_Q)


def _alpha_sql(items):
    k = len(items)
    return f"{k}.0 / {k - 1} * (1 - ({' + '.join(f'var_samp({i})' for i in items)}) / var_samp({' + '.join(items)}))"


_PAIRS = [(a, b) for i, a in enumerate(_Q) for b in _Q[i + 1:]]


@query("cronbach_alpha", f"""WITH {V.ITEMS}, r AS (SELECT count(*) AS n, {_alpha_sql(_Q)} AS a, ({' + '.join(f'corr({a}, {b})' for a, b in _PAIRS)}) / 15 AS rb FROM v_items)
  SELECT n, round(a, 6) AS alpha, round(6 * rb / (1 + 5 * rb), 6) AS alpha_standardized, round(rb, 6) AS mean_inter_item_r FROM r""")
def cronbach_alpha(spark, d):
    return rounded(S.reliability(V.items(spark, d), _Q)["reliability"].drop("items"))


@query("item_statistics", f"WITH {V.ITEMS} " + " UNION ALL ".join(
    f"""SELECT '{q}' AS item, round(avg({q}), 6) AS mean, round(stddev_samp({q}), 6) AS sd, round(corr({q}, {_SUM} - {q}), 6) AS item_total_r,
    round({_alpha_sql([x for x in _Q if x != q])}, 6) AS alpha_if_deleted FROM v_items""" for q in _Q))
def item_statistics(spark, d):
    return rounded(S.reliability(V.items(spark, d), _Q)["items"].drop("reversed"))


@query("icc", f"""WITH {V.ITEMS}, x AS (SELECT vec_id, unnest([r1, r2, r3]) AS v, unnest([1, 2, 3]) AS j FROM v_items), g AS (SELECT avg(v) AS gm, count(*) / 3 AS n FROM x),
  s AS (SELECT (SELECT 3 * sum((m - gm) ** 2) / (max(n) - 1) FROM (SELECT avg(v) AS m FROM x GROUP BY vec_id), g) AS msr,
   (SELECT max(n) * sum((m - gm) ** 2) / 2 FROM (SELECT avg(v) AS m FROM x GROUP BY j), g) AS msc, (SELECT sum((v - gm) ** 2) FROM x, g) AS sst, (SELECT n FROM g) AS n),
  t AS (SELECT *, (sst - msr * (n - 1) - msc * 2) / ((n - 1) * 2) AS mse, (sst - msr * (n - 1)) / (n * 2) AS msw FROM s)
  SELECT unnest(['ICC1', 'ICC2', 'ICC3', 'ICC1k', 'ICC2k', 'ICC3k']) AS form, unnest([round((msr - msw) / (msr + 2 * msw), 6), round((msr - mse) / (msr + 2 * mse + 3 * (msc - mse) / n), 6),
   round((msr - mse) / (msr + 2 * mse), 6), round((msr - msw) / msr, 6), round((msr - mse) / (msr + (msc - mse) / n), 6), round((msr - mse) / msr, 6)]) AS icc, CAST(n AS BIGINT) AS targets FROM t""")
def icc(spark, d):
    return rounded(S.icc(V.items(spark, d), "r1,r2,r3").drop("raters"))


@query("principal_factors", f"""WITH {V.ITEMS}, c AS (SELECT corr(r1, r2) AS r FROM v_items)
  SELECT 1 AS component, round(1 + abs(r), 6) AS eigenvalue, round((1 + abs(r)) / 2, 6) AS share, round((1 + abs(r)) / 2, 6) AS cumulative FROM c
  UNION ALL SELECT 2, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6), 1.0 FROM c""")
def principal_factors(spark, d):
    return rounded(S.principal_factors(V.items(spark, d), "r1,r2", 1)["eigenvalues"])


@query("bartlett_kmo", f"""WITH {V.ITEMS}, c AS (SELECT count(*) AS n, corr(r1, r2) AS a, corr(r1, r3) AS b, corr(r2, r3) AS c FROM v_items),
  x AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS pb, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS pc FROM c)
  SELECT n, round((a * a + b * b + c * c) / (a * a + b * b + c * c + pa * pa + pb * pb + pc * pc), 6) AS kmo, round(-ln(det) * (n - 1 - 11 / 6.0), 6) AS bartlett, 3 AS df FROM x""")
def bartlett_kmo(spark, d):
    return rounded(S.principal_factors(V.items(spark, d), "r1,r2,r3", 1)["tests"].drop("p"))


@query("factor_loadings")
def factor_loadings(spark, d):
    return S.principal_factors(V.items(spark, d), _Q, 2)["loadings"]


_CON = {"a": ["q1", "q2", "q3"], "b": ["q4", "q5", "q6"]}


@query("htmt", f"""WITH {V.ITEMS}, c AS (SELECT ({' + '.join(f'abs(corr({x}, {y}))' for x in _CON['a'] for y in _CON['b'])}) / 9 AS het,
  (abs(corr(q1, q2)) + abs(corr(q1, q3)) + abs(corr(q2, q3))) / 3 AS ma, (abs(corr(q4, q5)) + abs(corr(q4, q6)) + abs(corr(q5, q6))) / 3 AS mb FROM v_items)
  SELECT 'a' AS a, 'b' AS b, round(het / sqrt(ma * mb), 6) AS htmt FROM c""")
def htmt(spark, d):
    return rounded(S.htmt(V.items(spark, d), _CON))


@query("construct_validity", f"""WITH {V.ITEMS} SELECT 'a' AS construct, 3 AS items, count(*) AS n, round({_alpha_sql(_CON['a'])}, 6) AS alpha, round(2.1 * 2.1 / (2.1 * 2.1 + 3 - 1.49), 6) AS cr, round(1.49 / 3, 6) AS ave FROM v_items
  UNION ALL SELECT 'b', 3, count(*), round({_alpha_sql(_CON['b'])}, 6), NULL, NULL FROM v_items""")
def construct_validity(spark, d):
    return rounded(S.construct_validity(V.items(spark, d), _CON, {"a": [0.6, 0.7, 0.8]})["reliability"])


_AG = """t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c), cats AS (SELECT x AS v FROM c UNION SELECT y FROM c), q AS (SELECT count(*) AS q FROM cats),
  mg AS (SELECT v, coalesce((SELECT sum(n) FROM c WHERE x = v), 0) / t AS px, coalesce((SELECT sum(n) FROM c WHERE y = v), 0) / t AS py, row_number() OVER (ORDER BY v) - 1 AS i FROM cats, t),
  s AS (SELECT t, q, (SELECT sum(n) FROM c WHERE x = y) / t AS po, (SELECT sum(px * py) FROM mg) AS pe, (SELECT sum((px + py) / 2 * (1 - (px + py) / 2)) FROM mg) / (q - 1) AS pg FROM t, q)"""


@query("agreement_binary", f"""WITH c AS (SELECT CAST(quality AS VARCHAR) AS x, CAST(toxic AS VARCHAR) AS y, count(*) AS n FROM labels GROUP BY 1, 2), {_AG}
  SELECT CAST(t AS BIGINT) AS n, round(100 * po, 6) AS percent_agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pg) / (1 - pg), 6) AS ac1 FROM s""")
def agreement_binary(spark, d):
    return rounded(A.agreement(V.doc_labels(spark, d), "quality", "toxic")["statistics"].drop("few_units"))


@query("agreement_ordered", f"""WITH {V.ITEMS}, c AS (SELECT CAST(q1 AS VARCHAR) AS x, CAST(q2 AS VARCHAR) AS y, count(*) AS n FROM v_items GROUP BY 1, 2), {_AG},
  w AS (SELECT (SELECT sum(n * abs(a.i - b.i)) FROM c JOIN mg a ON a.v = c.x JOIN mg b ON b.v = c.y) AS o1, (SELECT sum(n * (a.i - b.i) ** 2) FROM c JOIN mg a ON a.v = c.x JOIN mg b ON b.v = c.y) AS o2,
   (SELECT sum(a.px * b.py * abs(a.i - b.i)) FROM mg a, mg b) AS e1, (SELECT sum(a.px * b.py * (a.i - b.i) ** 2) FROM mg a, mg b) AS e2)
  SELECT CAST(t AS BIGINT) AS n, round(100 * po, 6) AS percent_agreement, round((po - pe) / (1 - pe), 6) AS kappa, round(1 - o1 / t / e1, 6) AS kappa_linear, round(1 - o2 / t / e2, 6) AS kappa_quadratic,
   round((po - pg) / (1 - pg), 6) AS ac1 FROM s, w""")
def agreement_ordered(spark, d):
    return rounded(A.agreement(V.items(spark, d), "q1", "q2", ordered=True)["statistics"].drop("few_units"))


@query("agreement_confusion", "SELECT CAST(quality AS VARCHAR) AS rater1, CAST(toxic AS VARCHAR) AS rater2, count(*) AS n FROM labels GROUP BY 1, 2")
def agreement_confusion(spark, d):
    return A.agreement(V.doc_labels(spark, d), "quality", "toxic")["confusion"]


@query("agreement_primary_rule", f"""WITH c AS (SELECT CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS x, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS y, count(*) AS n FROM labels GROUP BY 1, 2), {_AG},
  p AS (SELECT sum(n) FILTER (x = 'Yes') / sum(n) AS prev FROM c)
  SELECT CAST(t AS BIGINT) AS n, round(po, 6) AS raw_agreement, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pg) / (1 - pg), 6) AS ac1, round(prev, 6) AS prevalence,
   CASE WHEN prev > 0.8 OR prev < 0.2 THEN 'AC1' ELSE 'kappa' END AS primary_statistic FROM s, p""")
def agreement_primary_rule(spark, d):
    t = V.table(spark, d, "labels").select(*[F.when(F.col(c) == 1, "Yes").otherwise("No").alias(c) for c in ("quality", "toxic")])
    return rounded(A.agreement_with_primary(t, "quality", "toxic"))


_KV = """d AS (SELECT lang, doc_id, CAST(quality AS VARCHAR) AS c0, CASE WHEN doc_id % 5 > 0 THEN CAST(toxic AS VARCHAR) END AS c1, CASE WHEN doc_id % 7 > 0 THEN CAST(long AS VARCHAR) END AS c2 FROM v_doc)"""


def _coders(spark, d):
    return V.doc_labels(spark, d).select(
        "lang", F.col("quality").cast("string").alias("c0"), F.when(F.col("doc_id") % 5 > 0, F.col("toxic").cast("string")).alias("c1"), F.when(F.col("doc_id") % 7 > 0, F.col("long").cast("string")).alias("c2"))


@query("krippendorff_alpha", f"""WITH {V.DOC_LABELS}, {_KV}, v AS (SELECT lang, doc_id, unnest([c0, c1, c2]) AS v FROM d), u AS (SELECT lang, doc_id, v, count(*) OVER (PARTITION BY doc_id) AS m FROM v WHERE v IS NOT NULL),
  o AS (SELECT a.lang, a.v AS a, b.v AS b, sum(na * (nb - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) * 1.0 / (m - 1)) AS o FROM (SELECT lang, doc_id, v, m, count(*) AS na FROM u WHERE m >= 2 GROUP BY ALL) a
   JOIN (SELECT doc_id, v, count(*) AS nb FROM u GROUP BY ALL) b ON a.doc_id = b.doc_id GROUP BY ALL),
  nc AS (SELECT lang, a, sum(o) AS n FROM o GROUP BY 1, 2), n AS (SELECT lang, sum(n) AS n, sum(n * n) AS sq FROM nc GROUP BY 1), dd AS (SELECT lang, sum(o) FILTER (a <> b) AS dis FROM o GROUP BY 1),
  raw AS (SELECT lang, count(*) AS units, avg(CASE WHEN c0 = c1 AND c1 = c2 THEN 1.0 ELSE 0.0 END) FILTER (c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL) AS ra FROM d GROUP BY 1)
  SELECT lang AS family, units, round(1 - (dis / n) / ((n * n - sq) / (n * (n - 1))), 6) AS alpha, round(ra, 6) AS raw_agreement FROM n JOIN dd USING (lang) JOIN raw USING (lang)""")
def krippendorff_alpha(spark, d):
    return rounded(A.krippendorff_alpha(_coders(spark, d), "c0,c1,c2", by="lang")["alpha"])


@query("krippendorff_disagreement", f"WITH {V.DOC_LABELS}, {_KV} SELECT lang AS family, coalesce(c0, '(missing)') AS first, coalesce(c1, '(missing)') AS second, count(*) AS n FROM d GROUP BY 1, 2, 3")
def krippendorff_disagreement(spark, d):
    return A.krippendorff_alpha(_coders(spark, d), "c0,c1,c2", by="lang")["disagreement"]


@query("fuzzy_calibration_summary", f"""WITH {V.FUZZY}, x AS (SELECT 'raw' AS variable, c_acctbal AS v FROM v_cust UNION ALL SELECT 'membership', {V._calibrate_sql('c_acctbal', -500, 4500, 9000)} FROM v_cust)
  SELECT variable, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, round(min(v), 5) AS min, round(max(v), 5) AS max, round(quantile_cont(v, 0.05), 5) AS p05, round(quantile_cont(v, 0.25), 5) AS p25,
   round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75, round(quantile_cont(v, 0.95), 5) AS p95 FROM x GROUP BY 1""")
def fuzzy_calibration_summary(spark, d):
    return rounded(Z.calibration(V.table(spark, d, "customer"), "c_acctbal", -500, 4500, 9000)["summary"], 5)


_C3 = ["rich", "busy", "settled"]


@query("necessity", f"WITH {V.FUZZY} " + " UNION ALL ".join(
    f"SELECT '{n}' AS condition, round(sum(least({x}, dear)) / sum(dear), 6) AS consistency, round(sum(least({x}, dear)) / sum({x}), 6) AS coverage FROM v_fuzzy"
    for c in _C3 for n, x in ((c, c), ("~" + c, f"(1 - {c})"))))
def necessity(spark, d):
    return rounded(Z.fsqca(V.fuzzy(spark, d), _C3, "dear")["necessity"])


@query("truth_table", f"""WITH {V.FUZZY}, b AS (SELECT a.b AS rich_, c.b AS busy_, e.b AS settled_ FROM (VALUES (0), (1)) a(b), (VALUES (0), (1)) c(b), (VALUES (0), (1)) e(b)),
  m AS (SELECT rich_, busy_, settled_, least(CASE rich_ WHEN 1 THEN rich ELSE 1 - rich END, CASE busy_ WHEN 1 THEN busy ELSE 1 - busy END, CASE settled_ WHEN 1 THEN settled ELSE 1 - settled END) AS x, dear AS y,
   (rich >= 0.5) = (rich_ = 1) AND (busy >= 0.5) = (busy_ = 1) AND (settled >= 0.5) = (settled_ = 1) AS hit FROM b, v_fuzzy),
  s AS (SELECT rich_ AS rich, busy_ AS busy, settled_ AS settled, count(*) FILTER (hit) AS cases, sum(least(x, y)) / sum(x) AS cons, (sum(least(x, y)) - sum(least(x, y, 1 - y))) / (sum(x) - sum(least(x, y, 1 - y))) AS pri,
   sum(least(x, y)) / sum(y) AS cov FROM m GROUP BY 1, 2, 3)
  SELECT rich, busy, settled, cases, round(cons, 6) AS consistency, round(pri, 6) AS pri, round(cov, 6) AS coverage, cases >= 5 AND cons >= 0.75 AND pri >= 0.3 AS sufficient FROM s""")
def truth_table(spark, d):
    return rounded(Z.fsqca(V.fuzzy(spark, d), _C3, "dear", 5, 0.75, 0.3)["truth_table"])


@query("term_coverage", f"""WITH {V.FUZZY}, t AS (SELECT least(rich, 1 - busy) AS a, settled AS b, dear AS y FROM v_fuzzy)
  SELECT 'rich*~busy' AS term, round(sum(least(a, y)) / sum(a), 6) AS consistency, round(sum(least(a, y)) / sum(y), 6) AS raw_coverage, round(sum(greatest(a - b, 0)) / sum(y), 6) AS unique_coverage FROM t
  UNION ALL SELECT 'settled', round(sum(least(b, y)) / sum(b), 6), round(sum(least(b, y)) / sum(y), 6), round(sum(greatest(b - a, 0)) / sum(y), 6) FROM t""")
def term_coverage(spark, d):
    return rounded(Z.term_coverage(V.fuzzy(spark, d), [{"rich": 1, "busy": 0}, {"settled": 1}], "dear")["terms"])


@query("solution_coverage", f"""WITH {V.FUZZY}, t AS (SELECT greatest(least(rich, 1 - busy), settled) AS a, dear AS y FROM v_fuzzy)
  SELECT round(sum(least(a, y)) / sum(a), 6) AS consistency, round(sum(least(a, y)) / sum(y), 6) AS coverage FROM t""")
def solution_coverage(spark, d):
    return rounded(Z.term_coverage(V.fuzzy(spark, d), [{"rich": 1, "busy": 0}, {"settled": 1}], "dear")["solution"])


@query("dyad_gap", f"""WITH {V.DYADS}, p AS (SELECT dyad, max(balance) FILTER (side = 'A') AS ba, max(balance) FILTER (side = 'B') AS bb, max(n_orders) FILTER (side = 'A') AS na, max(n_orders) FILTER (side = 'B') AS nb
   FROM v_dyads GROUP BY 1 HAVING count(DISTINCT side) = 2)
  SELECT 'balance' AS variable, count(*) AS complete_dyads, round(avg(abs(ba - bb)), 6) AS mean_abs_gap, round(corr(ba, bb), 6) AS r, round(quantile_cont(abs(ba - bb), 0.5), 6) AS median_abs_gap FROM p WHERE ba IS NOT NULL AND bb IS NOT NULL
  UNION ALL SELECT 'n_orders', count(*), round(avg(abs(na - nb)), 6), round(corr(na, nb), 6), round(quantile_cont(abs(na - nb), 0.5), 6) FROM p""")
def dyad_gap(spark, d):
    return rounded(Z.dyad_gap(V.dyads(spark, d), "dyad", "side", "balance,n_orders")["gaps"])


@query("case_code_matrix", f"WITH {V.CODING} SELECT CAST(case_id AS VARCHAR) AS \"case\", code, count(*) AS n FROM v_coding GROUP BY 1, 2")
def case_code_matrix(spark, d):
    return G.case_code_matrix(V.coding(spark, d), "case_id", "code", "source_id")["matrix"]


@query("case_provenance", f"""WITH {V.CODING}, m AS (SELECT case_id, direction, count(*) AS n FROM v_coding GROUP BY 1, 2)
  SELECT case_id, count(*) AS coded_units, count(DISTINCT source_id) AS distinct_sources, count(DISTINCT code) AS distinct_codes,
   (SELECT direction FROM m WHERE m.case_id = v.case_id ORDER BY n DESC, direction LIMIT 1) AS form FROM v_coding v GROUP BY 1""")
def case_provenance(spark, d):
    return G.case_code_matrix(V.coding(spark, d), "case_id", "code", "source_id", form="direction")["provenance"]


@query("case_conflicts", f"""WITH {V.CODING} SELECT case_id AS "case", code, count(DISTINCT source_id) AS sources FROM v_coding GROUP BY 1, 2
  HAVING bool_or(direction = 'support') AND bool_or(direction = 'oppose')""")
def case_conflicts(spark, d):
    return G.case_code_matrix(V.coding(spark, d), "case_id", "code", "source_id", direction="direction")["conflicts"]


@query("case_directions", f"WITH {V.CODING} SELECT CAST(case_id AS VARCHAR) AS \"case\", code, direction, count(*) AS n FROM v_coding GROUP BY 1, 2, 3")
def case_directions(spark, d):
    return G.case_code_matrix(V.coding(spark, d), "case_id", "code", "source_id", direction="direction")["direction"]


@query("case_chronology", f"""WITH {V.CODING} SELECT case_id AS "case", CAST(min(datediff('day', DATE '1970-01-01', CAST(event_date AS DATE))) AS DOUBLE) AS first_day,
  CAST(max(datediff('day', DATE '1970-01-01', CAST(event_date AS DATE))) AS DOUBLE) AS last_day, count(*) AS dated FROM v_coding GROUP BY 1""")
def case_chronology(spark, d):
    return G.case_code_matrix(V.coding(spark, d), "case_id", "code", "source_id", date="event_date")["chronology"]


_TESTS = """v_tests AS (SELECT event_id, user_id AS case_id, event_id % 3 AS prop, ['straw-in-the-wind', 'hoop', 'smoking-gun', 'doubly-decisive'][event_id % 4 + 1] AS test,
  CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'fail' WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'unknown' ELSE 'pending' END AS outcome FROM events)"""


def _tests(spark, d):
    e = F.col("event_type")
    spelled = F.array(*[F.lit(x) for x in ("Straw", "hoop ", "Smoking_gun", "doubly decisive")])
    return V.table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("case_id"), (F.col("event_id") % 3).alias("prop"), F.element_at(spelled, (F.col("event_id") % 4 + 1).cast("int")).alias("test_type"),
        F.when(e == "click", "Pass").when(e == "view", " fail").when(e == "purchase", "pass").when(e == "error", "UNKNOWN").otherwise("pending").alias("result"))


@query("process_trace_register", f"WITH {_TESTS}, i(test, outcome, implication) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in G.IMPLICATIONS)
       + f") SELECT case_id, prop, test, outcome, event_id, coalesce(implication, '{G.UNRESOLVED}') AS implication FROM v_tests LEFT JOIN i USING (test, outcome)")
def process_trace_register(spark, d):
    return G.process_trace(_tests(spark, d), "case_id", "prop", "test_type", "result", "event_id")["register"]


@query("process_trace_pattern", f"WITH {_TESTS} SELECT CAST(case_id AS VARCHAR) AS \"case\", CAST(prop AS VARCHAR) AS proposition, test, outcome, count(*) AS n FROM v_tests GROUP BY 1, 2, 3, 4")
def process_trace_pattern(spark, d):
    return G.process_trace(_tests(spark, d), "case_id", "prop", "test_type", "result", "event_id")["pattern"]


@query("process_trace_unresolved", f"WITH {_TESTS} SELECT count(*) FILTER (outcome IN ('unknown', 'pending')) AS unresolved, count(*) AS tests FROM v_tests")
def process_trace_unresolved(spark, d):
    return G.process_trace(_tests(spark, d), "case_id", "prop", "test_type", "result", "event_id")["unresolved"]


@query("governance_cases", f"""WITH {V.CODING} SELECT case_id AS "case", arg_min(direction, source_id) AS direction, arg_min(code, source_id) AS code FROM v_coding GROUP BY 1""")
def governance_cases(spark, d):
    return G.governance_comparison(V.coding(spark, d), "case_id", "direction", "code", "source_id")["cases"]


@query("governance_conflicts", f"""WITH {V.CODING}, l AS (SELECT case_id, 'direction' AS field, direction AS v, min(source_id) AS o FROM v_coding GROUP BY 1, 3 UNION ALL SELECT case_id, 'code', code, min(source_id) FROM v_coding GROUP BY 1, 3)
  SELECT case_id AS "case", field, string_agg(v, ' | ' ORDER BY o, v) AS values FROM l GROUP BY 1, 2 HAVING count(*) > 1""")
def governance_conflicts(spark, d):
    return G.governance_comparison(V.coding(spark, d), "case_id", "direction", "code", "source_id")["conflicts"]


@query("governance_crosstab", f"""WITH {V.CODING}, c AS (SELECT case_id, arg_min(direction, source_id) AS form, arg_min(code, source_id) AS value FROM v_coding GROUP BY 1) SELECT form, value, count(*) AS n FROM c GROUP BY 1, 2""")
def governance_crosstab(spark, d):
    return G.governance_comparison(V.coding(spark, d), "case_id", "direction", "code", "source_id")["by_code"]
