"""Hypothesis tests and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import correlate as K
from tallyspark.operators import hypothesis as H
from tallyspark.operators import rank_tests as R
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded

_LEV = """z AS (SELECT g, abs(x - avg(x) OVER (PARTITION BY g)) AS z FROM d), zm AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY 1),
  lev AS (SELECT (sum(n) - count(*)) / (count(*) - 1) * sum(n * (m - zb) ** 2) / sum((n - 1) * v) AS f FROM zm, (SELECT avg(z) AS zb FROM z))"""


@query("t_independent", f"""WITH d AS (SELECT l_linestatus AS g, l_extendedprice AS x FROM lineitem), {_LEV},
  m AS (SELECT count(*) FILTER (g = 'F') AS n0, count(*) FILTER (g = 'O') AS n1, avg(x) FILTER (g = 'F') AS m0, avg(x) FILTER (g = 'O') AS m1,
   var_samp(x) FILTER (g = 'F') AS v0, var_samp(x) FILTER (g = 'O') AS v1 FROM d),
  p AS (SELECT *, m0 - m1 AS diff, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) AS pv, v0 / n0 AS e0, v1 / n1 AS e1 FROM m),
  t AS (SELECT 'Student' AS test, diff, sqrt(pv * (1.0 / n0 + 1.0 / n1)) AS se, CAST(n0 + n1 - 2 AS DOUBLE) AS df, diff / sqrt(pv) AS dd FROM p
   UNION ALL SELECT 'Welch', diff, sqrt(e0 + e1), (e0 + e1) ** 2 / (e0 ** 2 / (n0 - 1) + e1 ** 2 / (n1 - 1)), diff / sqrt(pv) FROM p)
  SELECT 'l_extendedprice' AS variable, test, round(diff, 4) AS difference, round(se, 6) AS se, round(df, 4) AS df, round(diff / se, 6) AS t, round(dd, 6) AS cohens_d,
   round(f, 6) AS levene_f FROM t, lev""")
def t_independent(spark, d):
    t = H.t_independent(V.lines(spark, d), "l_extendedprice", "l_linestatus")["tests"]
    return rounded(t.select("variable", "test", F.round("difference", 4).alias("difference"), "se", F.round("df", 4).alias("df"), "t", "cohens_d", "levene_f"))


@query("t_independent_groups", """SELECT 'l_extendedprice' AS variable, l_linestatus AS level, count(*) AS n, round(avg(l_extendedprice), 6) AS mean,
  round(stddev_samp(l_extendedprice), 6) AS sd, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS se_mean FROM lineitem GROUP BY 2""")
def t_independent_groups(spark, d):
    return rounded(H.t_independent(V.lines(spark, d), "l_extendedprice", "l_linestatus")["groups"])


@query("t_paired", f"""WITH {V.PAIRS}, m AS (SELECT count(*) AS n, avg(y1 - y2) AS mean, stddev_samp(y1 - y2) AS sd FROM v_pairs WHERE y1 - y2 IS NOT NULL)
  SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(sd / sqrt(n), 4) AS se, n - 1 AS df, round(mean / (sd / sqrt(n)), 6) AS t, round(mean / sd, 6) AS dz FROM m""")
def t_paired(spark, d):
    return rounded(H.t_paired(V.pairs(spark, d), "y1", "y2").select("n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "se")], "df", "t", "dz"))


@query("t_one_sample", f"WITH {V.LINES} " + " UNION ALL ".join(
    f"""SELECT '{x}' AS variable, count({x}) AS n, round(avg({x}), 6) AS mean, round((avg({x}) - 0.05) / (stddev_samp({x}) / sqrt(count({x}))), 5) AS t, count({x}) - 1 AS df FROM v_lines"""
    for x in ("x_null", "l_tax")))
def t_one_sample(spark, d):
    t = H.t_one_sample(V.lines(spark, d), "x_null,l_tax", mu=0.05)
    return rounded(t.select("variable", "n", "mean", F.round("t", 5).alias("t"), "df"))


_ANOVA = """m AS (SELECT g, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY 1),
  s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * (m - gm) ** 2) AS ssb, sum((n - 1) * v) AS ssw FROM m, (SELECT avg(x) AS gm FROM d))"""


@query("anova_oneway", f"""WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_ANOVA}
  SELECT k, n, round(ssb / n, 4) AS ssb_per_row, round(ssw / n, 4) AS ssw_per_row, k - 1 AS df_between, n - k AS df_within, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f,
   round(ssb / (ssb + ssw), 6) AS eta_squared, round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 6) AS omega_squared FROM s""")
def anova_oneway(spark, d):
    t = H.anova_oneway(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment", posthoc=False)["anova"]
    return rounded(t.select("k", "n", F.round(F.col("ss_between") / F.col("n"), 4).alias("ssb_per_row"), F.round(F.col("ss_within") / F.col("n"), 4).alias("ssw_per_row"),
                            "df_between", "df_within", "f", "eta_squared", "omega_squared"))


@query("anova_robust", f"""WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_ANOVA}, {_LEV},
  w AS (SELECT n, m, n / v AS w, sum(n / v) OVER () AS sw, sum(n / v * m) OVER () / sum(n / v) OVER () AS c FROM m),
  a AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(w * (m - c) ** 2) AS a, sum((1 - w / sw) ** 2 / (n - 1)) AS lam FROM w)
  SELECT 'Levene' AS test, round(f, 6) AS statistic, CAST(k - 1 AS DOUBLE) AS df1, CAST(n - k AS DOUBLE) AS df2 FROM lev, s
  UNION ALL SELECT 'Welch', round(a / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 6), k - 1, round((k * k - 1) / (3 * lam), 6) FROM a""")
def anova_robust(spark, d):
    return rounded(H.anova_oneway(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment", posthoc=False)["robust"].drop("p"))


@query("tukey_hsd", f"""WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), {_ANOVA}
  SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 6) AS difference, round(sqrt(ssw / (s.n - k) / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS se,
   round(abs(b.m - a.m) / sqrt(ssw / (s.n - k) / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q FROM m a JOIN m b ON a.g < b.g, s""")
def tukey_hsd(spark, d):
    t = H.anova_oneway(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment")["tukey"]
    return rounded(t.select("group1", "group2", "difference", "se", "q"))


@query("tukey_hsd_p_values")
def tukey_hsd_p_values(spark, d):
    return H.anova_oneway(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment")["tukey"]


@query("fisher_exact", """WITH d AS (SELECT d.source, l.quality = 0 AS r, l.toxic = 0 AS c FROM labels l JOIN documents d USING (doc_id)),
  t AS (SELECT source, count(*) FILTER (r AND c) AS a, count(*) FILTER (r) AS r1, count(*) FILTER (c) AS c1, count(*) AS n FROM d GROUP BY 1),
  x AS (SELECT *, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS x FROM t),
  p AS (SELECT *, lgamma(r1 + 1) + lgamma(n - r1 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) AS f FROM x),
  q AS (SELECT *, f - lgamma(x + 1) - lgamma(r1 - x + 1) - lgamma(c1 - x + 1) - lgamma(n - r1 - c1 + x + 1) AS lp,
    f - lgamma(a + 1) - lgamma(r1 - a + 1) - lgamma(c1 - a + 1) - lgamma(n - r1 - c1 + a + 1) AS lo FROM p)
  SELECT source, a, r1, c1, n, round(least(1.0, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM q GROUP BY ALL""".replace("range(", "generate_series(").replace("least(r1, c1) + 1)", "least(r1, c1))"))
def fisher_exact(spark, d):
    t = V.doc_labels(spark, d)
    return rounded(H.fisher_exact(t, "quality", "toxic", ["source"]))


@query("wilson_interval", """WITH s AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), p AS (SELECT *, 1.0 * k / n AS p, 1.959964 AS z FROM s)
  SELECT o_orderpriority, n, k, round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 6) AS low,
   round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 6) AS high FROM p""")
def wilson_interval(spark, d):
    s = V.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = H.wilson_interval(F.col("k"), F.col("n"))
    return rounded(s.select("o_orderpriority", "n", "k", low.alias("low"), high.alias("high")))


_RANK = "(count(*) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + count(*) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY x) + 1) / 2.0"


@query("mann_whitney", f"""WITH d AS (SELECT l_linestatus AS g, l_extendedprice AS x FROM lineitem), r AS (SELECT g, x, {_RANK} AS rk FROM d),
  t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY x)),
  s AS (SELECT CAST(count(*) FILTER (g = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'O') AS DOUBLE) AS n2, CAST(count(*) AS DOUBLE) AS n, sum(rk) FILTER (g = 'F') AS r1,
   quantile_cont(x, 0.5) FILTER (g = 'F') AS med1, quantile_cont(x, 0.5) FILTER (g = 'O') AS med2 FROM r),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM s, t),
  z AS (SELECT *, sign(u - n1 * n2 / 2) * greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sd AS z FROM u)
  SELECT 'l_extendedprice' AS variable, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, round(z, 6) AS z, round(abs(z) / sqrt(n), 6) AS r, round(med1, 6) AS median1, round(med2, 6) AS median2 FROM z""")
def mann_whitney(spark, d):
    return rounded(R.mann_whitney(V.lines(spark, d), "l_extendedprice", "l_linestatus").drop("p"))


@query("wilcoxon", f"""WITH {V.PAIRS}, a AS (SELECT k1 - k2 AS v FROM v_pairs WHERE k1 - k2 IS NOT NULL), d AS (SELECT v, abs(v) AS x FROM a WHERE v <> 0), r AS (SELECT v, x, {_RANK} AS rk FROM d),
  t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY x)),
  s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(rk) FILTER (v > 0) AS vv FROM r),
  z AS (SELECT n, vv, vv - n * (n + 1) / 4 AS gap, sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS sd FROM s, t)
  SELECT (SELECT count(*) FROM a) AS n_pairs, CAST(n AS BIGINT) AS n_nonzero, vv AS v, round(sign(gap) * greatest(abs(gap) - 0.5, 0) / sd, 6) AS z FROM z""")
def wilcoxon(spark, d):
    return rounded(R.wilcoxon(V.pairs(spark, d), "k1", "k2").drop("p"))


_KW = f"""WITH d AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), r AS (SELECT g, x, {_RANK} AS rk FROM d),
  gs AS (SELECT g, count(*) AS n, sum(rk) AS rs, quantile_cont(x, 0.5) AS med FROM r GROUP BY 1)"""


@query("kruskal", f"""{_KW}, t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY x)),
  s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(rs * rs / n) AS s, count(*) AS k FROM gs),
  h AS (SELECT n, k, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s, t)
  SELECT CAST(n AS BIGINT) AS n, round(h, 6) AS h, k - 1 AS df, round(h / (n - 1), 6) AS epsilon_squared FROM h""")
def kruskal(spark, d):
    return rounded(R.kruskal(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment")["test"].drop("p"))


@query("kruskal_ranks", f"{_KW} SELECT g AS level, n, round(rs / n, 6) AS mean_rank, round(med, 6) AS median FROM gs")
def kruskal_ranks(spark, d):
    return rounded(R.kruskal(V.table(spark, d, "customer"), "c_acctbal", "c_mktsegment")["ranks"])


_CV = ["l_quantity", "l_extendedprice", "x_null", "l_tax"]
_CP = [(a, b) for i, a in enumerate(_CV) for b in _CV[i + 1:]]


@query("correlation_pearson", f"WITH {V.LINES}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM v_lines" for a, b in _CP)
    + """) SELECT first, second, round(r, 6) AS r, n, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM c""")
def correlation_pearson(spark, d):
    return rounded(K.correlation(V.lines(spark, d), _CV).drop("p"))


def _spearman_sql(view, a, b):
    rk = lambda v: f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0)"
    return f"SELECT '{a}' AS first, '{b}' AS second, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT {rk(a)} AS ra, {rk(b)} AS rb FROM {view} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("correlation_spearman", f"WITH {V.LINES} " + " UNION ALL ".join(_spearman_sql("v_lines", a, b) for a, b in _CP))
def correlation_spearman(spark, d):
    t = K.correlation(V.lines(spark, d), _CV, "spearman").drop("p")
    return rounded(t)


@query("correlation_kendall", f"""WITH {V.CUSTOMERS}, d AS (SELECT CAST(n_orders AS BIGINT) AS x, c_nationkey AS y, count(*) AS c FROM v_cust GROUP BY 1, 2),
  p AS (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM d a, d b),
  t AS (SELECT CAST(sum(c) AS DOUBLE) AS n FROM d), tx AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT CAST(sum(c) AS DOUBLE) AS c FROM d GROUP BY x)),
  ty AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT CAST(sum(c) AS DOUBLE) AS c FROM d GROUP BY y))
  SELECT 'n_orders' AS first, 'c_nationkey' AS second, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS r, CAST(n AS BIGINT) AS n FROM p, t, tx, ty""")
def correlation_kendall(spark, d):
    return rounded(K.correlation(V.customers(spark, d), ["n_orders", "c_nationkey"], "kendall").select("first", "second", "r", "n"))
