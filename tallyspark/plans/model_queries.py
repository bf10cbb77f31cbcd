"""Regression and choice models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import linear as L
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded

# simple regression in closed form: slope, intercept, residuals
_SIMPLE = f"""{V.LINES}, d AS (SELECT l_extendedprice AS y, x_null AS x, l_suppkey AS g FROM v_lines WHERE x_null IS NOT NULL),
  m AS (SELECT count(*) AS n, avg(x) AS xb, avg(y) AS yb, count(*) * covar_pop(x, y) AS sxy, count(*) * var_pop(x) AS sxx, count(*) * var_pop(y) AS syy FROM d),
  r AS (SELECT x, y, g, n, xb, sxx, x - xb AS xc, (y - yb) - sxy / sxx * (x - xb) AS e FROM d, m),
  f AS (SELECT m.*, sxy / sxx AS b, yb - sxy / sxx * xb AS a, (SELECT sum(e * e) FROM r) AS rss FROM m)"""


@query("ols_simple", f"""WITH {_SIMPLE}
  SELECT '(Intercept)' AS term, round(a, 4) AS b, round(sqrt(rss / (n - 2) * (1.0 / n + xb * xb / sxx)), 4) AS se, n - 2 AS df FROM f
  UNION ALL SELECT 'x_null', round(b, 4), round(sqrt(rss / (n - 2) / sxx), 4), n - 2 FROM f""")
def ols_simple(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null")["coefficients"]
    return rounded(t.select("term", F.round("b", 4).alias("b"), F.round("se", 4).alias("se"), F.col("df").cast("bigint").alias("df")))


@query("ols_model_summary", f"""WITH {_SIMPLE} SELECT n, round(1 - rss / syy, 8) AS r2, round(1 - (rss / syy) * (n - 1) / (n - 2), 8) AS adj_r2,
  round((syy - rss) / (rss / (n - 2)), 5) AS f, round(sqrt(rss / (n - 2)), 4) AS rmse FROM f""")
def ols_model_summary(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null")["model"]
    return rounded(t.select("n", F.round("r2", 8).alias("r2"), F.round("adj_r2", 8).alias("adj_r2"), F.round("f", 5).alias("f"), F.round("rmse", 4).alias("rmse")), 8)


@query("ols_hc3", f"""WITH {_SIMPLE}, u AS (SELECT xc, e / (1 - 1.0 / n - xc * xc / sxx) AS u, sxx FROM r)
  SELECT 'x_null' AS term, round(sqrt(sum(xc * xc * u * u)) / max(sxx), 4) AS se FROM u""")
def ols_hc3(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null", se="HC3")["coefficients"]
    return rounded(t.where("term <> '(Intercept)'").select("term", F.round("se", 4).alias("se")))


@query("ols_cr1", f"""WITH {_SIMPLE}, s AS (SELECT g, sum(xc * e) AS s FROM r GROUP BY 1)
  SELECT 'x_null' AS term, round(sqrt(sum(s * s) / (SELECT sxx * sxx FROM m) * count(*) / (count(*) - 1) * (SELECT (n - 1.0) / (n - 2) FROM m)), 4) AS se, count(*) - 1 AS df FROM s""")
def ols_cr1(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null", se="CR1", cluster="l_suppkey")["coefficients"]
    return rounded(t.where("term <> '(Intercept)'").select("term", F.round("se", 4).alias("se"), F.col("df").cast("bigint").alias("df")))


@query("ols_cr0", f"""WITH {_SIMPLE}, s AS (SELECT g, sum(xc * e) AS s FROM r GROUP BY 1) SELECT 'x_null' AS term, round(sqrt(sum(s * s) / (SELECT sxx * sxx FROM m)), 4) AS se FROM s""")
def ols_cr0(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null", se="CR0", cluster="l_suppkey")["coefficients"]
    return rounded(t.where("term <> '(Intercept)'").select("term", F.round("se", 4).alias("se")))


# with one row a cluster the adjustment is the leverage of the row
@query("ols_cr2_singletons", f"""WITH {_SIMPLE}, u AS (SELECT xc, e / sqrt(1 - 1.0 / n - xc * xc / sxx) AS u, sxx FROM r)
  SELECT 'x_null' AS term, round(sqrt(sum(xc * xc * u * u)) / max(sxx), 4) AS se FROM u""")
def ols_cr2_singletons(spark, d):
    lines = V.lines(spark, d).withColumn("own", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.monotonically_increasing_id()))
    t = L.regression_linear(lines, "l_extendedprice", "x_null", se="CR2", cluster="own")["coefficients"]
    return rounded(t.where("term <> '(Intercept)'").select("term", F.round("se", 4).alias("se")))


@query("ols_cr2")
def ols_cr2(spark, d):
    return L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null,l_quantity", "l_returnflag", se="CR2", cluster="l_suppkey")["coefficients"]


@query("wls_cr2")
def wls_cr2(spark, d):
    return L.regression_linear(V.lines(spark, d), "l_extendedprice", "x_null,l_tax", se="CR2", cluster="l_suppkey", weight="l_quantity")["coefficients"]


@query("wls_simple", f"""WITH d AS (SELECT l_extendedprice AS y, l_tax AS x, l_quantity AS w FROM lineitem), m AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS xb, sum(w * y) / sum(w) AS yb FROM d),
  s AS (SELECT sum(w * (x - xb) * (x - xb)) AS sxx, sum(w * (x - xb) * (y - yb)) AS sxy, sum(w * (y - yb) * (y - yb)) AS syy FROM d, m)
  SELECT '(Intercept)' AS term, round(yb - sxy / sxx * xb, 4) AS b, round(sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 / sw + xb * xb / sxx)), 4) AS se FROM s, m
  UNION ALL SELECT 'l_tax', round(sxy / sxx, 4), round(sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) FROM s, m""")
def wls_simple(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "l_tax", weight="l_quantity")["coefficients"]
    return rounded(t.select("term", F.round("b", 4).alias("b"), F.round("se", 4).alias("se")))


@query("ols_categorical", """WITH g AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS m, count(*) AS n, (count(*) - 1) * var_samp(c_acctbal) AS ss FROM customer GROUP BY 1),
  e AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2 FROM g), b AS (SELECT m AS m0, n AS n0 FROM g WHERE s = 'AUTOMOBILE')
  SELECT CASE WHEN s = 'AUTOMOBILE' THEN '(Intercept)' ELSE 'c_mktsegment=' || s END AS term, round(CASE WHEN s = 'AUTOMOBILE' THEN m ELSE m - m0 END, 5) AS b,
   round(sqrt(s2 * (1.0 / n0 + CASE WHEN s = 'AUTOMOBILE' THEN 0 ELSE 1.0 / n END)), 5) AS se FROM g, e, b""")
def ols_categorical(spark, d):
    t = L.regression_linear(V.table(spark, d, "customer"), "c_acctbal", None, "c_mktsegment")["coefficients"]
    return rounded(t.select("term", F.round("b", 5).alias("b"), F.round("se", 5).alias("se")))


@query("vif", f"WITH {V.LINES} SELECT 'l_quantity' AS term, round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) AS vif FROM v_lines UNION ALL SELECT 'l_extendedprice', round(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) FROM v_lines")
def vif(spark, d):
    return rounded(L.regression_linear(V.lines(spark, d), "l_tax", "l_quantity,l_extendedprice")["vif"])


@query("standardized_beta", "SELECT 'l_quantity' AS term, round(corr(l_quantity, l_extendedprice), 6) AS beta FROM lineitem")
def standardized_beta(spark, d):
    t = L.regression_linear(V.lines(spark, d), "l_extendedprice", "l_quantity")["coefficients"]
    return rounded(t.where("beta is not null").select("term", "beta"))


@query("incremental_validity", """WITH c AS (SELECT count(*) AS n, corr(l_extendedprice, l_quantity) AS r1, corr(l_extendedprice, l_discount) AS r2, corr(l_quantity, l_discount) AS r12 FROM lineitem),
  r AS (SELECT n, r1 * r1 AS base, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS full_ FROM c)
  SELECT n, round(base, 8) AS base_r2, round(full_, 8) AS full_r2, round((full_ - base) / ((1 - full_) / (n - 3)), 5) AS f_change FROM r""")
def incremental_validity(spark, d):
    t = L.incremental_validity(V.lines(spark, d), "l_extendedprice", "l_quantity", "l_discount", cluster="l_suppkey")["comparison"]
    return rounded(t.select("n", F.round("base_r2", 8).alias("base_r2"), F.round("full_r2", 8).alias("full_r2"), F.round("f_change", 5).alias("f_change")), 8)


@query("incremental_validity_coefficients")
def incremental_validity_coefficients(spark, d):
    return L.incremental_validity(V.lines(spark, d), "l_extendedprice", "l_quantity", "l_discount", cluster="l_suppkey")["coefficients"]


@query("panel_first_difference", f"""WITH {V.PAIRS}, d AS (SELECT y2 - y1 AS y, k2 - k1 AS x FROM v_pairs WHERE y2 - y1 IS NOT NULL),
  m AS (SELECT count(*) AS n, avg(x) AS xb, avg(y) AS yb, count(*) * covar_pop(x, y) AS sxy, count(*) * var_pop(x) AS sxx FROM d),
  u AS (SELECT x - xb AS xc, ((y - yb) - sxy / sxx * (x - xb)) / (1 - 1.0 / n - (x - xb) ** 2 / sxx) AS u FROM d, m)
  SELECT 'd_orders' AS term, round(max(sxy / sxx), 4) AS b, round(sqrt(sum(xc * xc * u * u)) / max(sxx), 4) AS se FROM u, m""")
def panel_first_difference(spark, d):
    t = L.panel_first_difference(V.pairs(spark, d), "y1", "y2", {"orders": ("k1", "k2")}, cluster="o_custkey")["coefficients"]
    return rounded(t.where("term <> '(Intercept)'").select("term", F.round("b", 4).alias("b"), F.round("se", 4).alias("se")))


def choice_rows(spark, d):
    """Orders as choice tasks, which need two lines at least; the dearest line is chosen when its price is above 60,000."""
    ol = V.ordered_lines(spark, d)
    # the order's roll-up is a partial aggregate joined back, so a very large order is not gathered in one window
    size = ol.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("m"), F.max_by("ln", F.struct(F.col("l_extendedprice"), -F.col("ln"))).alias("best")).where("m >= 2")
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("respondent"), F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 2, "high").otherwise("low").alias("urgency"))
    q = F.col("l_quantity")
    return ol.join(size, "l_orderkey").join(o, ol.l_orderkey == o.o_orderkey).select(
        "respondent", F.col("l_orderkey").alias("task"), F.col("ln").alias("alternative"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.when(q <= 15, "a_small").when(q <= 35, "b_medium").otherwise("c_large").alias("band"), "urgency",
        F.when((F.col("ln") == F.col("best")) & (F.col("l_extendedprice") > 60000), 1).otherwise(0).alias("chosen"))


CHOICE = f"""{V.ORDERED_LINES}, sz AS (SELECT l_orderkey, count(*) AS m, arg_max(ln, (l_extendedprice, -ln)) AS best FROM v_ol GROUP BY 1 HAVING count(*) >= 2),
  v_choice AS (SELECT o_custkey AS respondent, l_orderkey AS task, ln AS alternative, l_returnflag AS flag, l_linestatus AS status,
   CASE WHEN l_quantity <= 15 THEN 'a_small' WHEN l_quantity <= 35 THEN 'b_medium' ELSE 'c_large' END AS band,
   CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'high' ELSE 'low' END AS urgency,
   CASE WHEN ln = best AND l_extendedprice > 60000 THEN 1 ELSE 0 END AS chosen FROM v_ol JOIN sz USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey)"""


@query("conjoint_amce", f"""WITH {CHOICE}, s AS (SELECT band AS l, avg(chosen) AS m FROM v_choice GROUP BY 1)
  SELECT CASE WHEN l = 'a_small' THEN '(Intercept)' ELSE 'band=' || l END AS term, round(CASE WHEN l = 'a_small' THEN m ELSE m - (SELECT m FROM s WHERE l = 'a_small') END, 6) AS b FROM s""")
def conjoint_amce(spark, d):
    return rounded(L.conjoint_amce(choice_rows(spark, d), "band", "chosen", "respondent")["amce"].select("term", "b"))


@query("conjoint_interactions")
def conjoint_interactions(spark, d):
    return L.conjoint_amce(choice_rows(spark, d), "flag,band", "chosen", "respondent", factor="urgency")["interactions"]


@query("reject_both_rate", f"""WITH {CHOICE}, t AS (SELECT respondent, task, max(chosen) AS c, min(urgency) AS u FROM v_choice GROUP BY 1, 2)
  SELECT u AS factor_level, round(1 - avg(c), 6) AS reject_both_rate, count(*) AS tasks FROM t GROUP BY 1""")
def reject_both_rate(spark, d):
    return rounded(L.reject_both_rate(choice_rows(spark, d), "chosen", "respondent", "urgency"))


@query("design_balance", f"""WITH {CHOICE}, l AS (SELECT 'flag' AS attribute, flag AS level FROM v_choice UNION ALL SELECT 'status', status FROM v_choice),
  c AS (SELECT attribute, level, count(*) AS n FROM l GROUP BY 1, 2)
  SELECT attribute, level, round(n / sum(n) OVER (PARTITION BY attribute), 6) AS share, round(1.0 / count(*) OVER (PARTITION BY attribute), 6) AS expected FROM c""")
def design_balance(spark, d):
    return rounded(L.design_diagnostics(choice_rows(spark, d), "flag,status")["balance"])


@query("design_association", f"""WITH {CHOICE}, c AS (SELECT flag AS r, status AS k, count(*) AS n FROM v_choice GROUP BY 1, 2),
  g AS (SELECT c.n, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY k) * 1.0 / sum(n) OVER () AS e, sum(n) OVER () AS t FROM c)
  SELECT 'flag' AS first, 'status' AS second, round(sqrt(sum((n - e) ** 2 / e) / max(t)), 6) AS cramers_v FROM g""")
def design_association(spark, d):
    return rounded(L.design_diagnostics(choice_rows(spark, d), "flag,status")["association"])


@query("design_factor_by_block", f"WITH {CHOICE} SELECT status AS block, urgency AS factor_level, count(*) / 2 AS tasks FROM v_choice GROUP BY 1, 2")
def design_factor_by_block(spark, d):
    return L.design_diagnostics(choice_rows(spark, d), "flag", "urgency", "status")["factor_by_block"]


@query("performance", """WITH r AS (SELECT l_suppkey % 10 AS scenario, avg(l_discount) AS e, stddev_samp(l_discount) / sqrt(count(*)) AS s FROM lineitem GROUP BY l_suppkey),
  x AS (SELECT *, CASE WHEN abs(e - 0.05) <= 1.96 * s THEN 1.0 ELSE 0.0 END AS cover, CASE WHEN e / s > 60 THEN 1.0 ELSE 0.0 END AS rej FROM r)
  SELECT scenario, count(e) AS replicates, CASE WHEN count(e) >= 2 THEN round(avg(e - 0.05), 8) END AS bias, round(stddev_samp(e), 8) AS empirical_se, CASE WHEN count(e) >= 2 THEN round(sqrt(avg(s * s)), 8) END AS model_se,
   CASE WHEN count(e) >= 2 THEN round(sqrt(avg((e - 0.05) ** 2)), 8) END AS rmse, CASE WHEN count(e) >= 2 THEN avg(cover) END AS coverage, CASE WHEN count(e) >= 2 THEN round(sqrt(avg(cover) * (1 - avg(cover)) / count(*)), 8) END AS coverage_mcse,
   CASE WHEN count(e) >= 2 THEN avg(rej) END AS rejection FROM x GROUP BY 1""")
def performance(spark, d):
    r = V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("e"), (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("s"))
    r = r.select((F.col("l_suppkey") % 10).alias("scenario"), "e", "s", (F.col("e") - 1.96 * F.col("s")).alias("lo"), (F.col("e") + 1.96 * F.col("s")).alias("hi"),
                 F.when(F.col("e") / F.col("s") > 60, 0.0).otherwise(1.0).alias("p"), F.lit(0.05).alias("truth"))
    t = L.performance(r, "e", "s", "lo", "hi", "p", "truth", ["scenario"])
    return rounded(t.select("scenario", "replicates", *[F.round(c, 8).alias(c) for c in ("bias", "empirical_se", "model_se", "rmse")], "coverage", F.round("coverage_mcse", 8).alias("coverage_mcse"), "rejection"), 8)


# ---------------------------------------------------------------- maximum likelihood
from tallyspark.operators import choice as CH  # noqa: E402
from tallyspark.operators import glm as G  # noqa: E402
from tallyspark.operators import overlap as O  # noqa: E402
from tallyspark.operators import survival as SV  # noqa: E402


# with one binary predictor the logistic model is saturated: odds ratios follow from the four counts
@query("logistic_binary", """WITH c AS (SELECT CAST(count(*) FILTER (toxic = 0 AND quality = 0) AS DOUBLE) AS a, count(*) FILTER (toxic = 0 AND quality = 1) AS b, count(*) FILTER (toxic = 1 AND quality = 0) AS c, count(*) FILTER (toxic = 1 AND quality = 1) AS d FROM labels)
  SELECT '(Intercept)' AS term, round(ln(b / a), 5) AS b, round(sqrt(1 / a + 1.0 / b), 5) AS se FROM c UNION ALL SELECT 'toxic', round(ln((a * d) / (b * c)), 5), round(sqrt(1 / a + 1.0 / b + 1.0 / c + 1.0 / d), 5) FROM c""")
def logistic_binary(spark, d):
    return rounded(G.regression_logistic(V.table(spark, d, "labels"), "quality", "toxic")["coefficients"].select("term", F.round("b", 5).alias("b"), F.round("se", 5).alias("se")), 5)


@query("logistic_model", """WITH g AS (SELECT toxic, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS k FROM labels GROUP BY 1), t AS (SELECT sum(n) AS n, sum(k) AS k, sum(k * ln(k / n) + (n - k) * ln(1 - k / n)) AS l1 FROM g), m AS (SELECT n, k, l1, k * ln(k / n) + (n - k) * ln(1 - k / n) AS l0 FROM t)
  SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS events, round(-2 * l1, 5) AS minus_2ll, round(2 * (l1 - l0), 5) AS lr, round(1 - l1 / l0, 6) AS mcfadden, round(1 - exp(2 * (l0 - l1) / n), 6) AS cox_snell, round((1 - exp(2 * (l0 - l1) / n)) / (1 - exp(2 * l0 / n)), 6) AS nagelkerke FROM m""")
def logistic_model(spark, d):
    m = G.regression_logistic(V.table(spark, d, "labels"), "quality", "toxic")["model"]
    return rounded(m.select("n", "events", F.round("minus_2ll", 5).alias("minus_2ll"), F.round("lr", 5).alias("lr"), "mcfadden", "cox_snell", "nagelkerke"))


@query("logistic_classification", "SELECT quality AS observed, 1 AS predicted, count(*) AS n FROM labels GROUP BY 1")
def logistic_classification(spark, d):
    return G.regression_logistic(V.table(spark, d, "labels"), "quality", "toxic")["classification"]


@query("logistic_clustered")
def logistic_clustered(spark, d):
    t = V.customers(spark, d).withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    return G.regression_logistic(t, "rich", "n_orders,mean_price", "c_mktsegment", cluster="c_nationkey")["coefficients"]


@query("multinomial_binary", f"""WITH {V.CUSTOMERS}, g AS (SELECT c_mktsegment AS s, CAST(count(*) FILTER (c_acctbal > 5000) AS DOUBLE) AS r, CAST(count(*) FILTER (NOT c_acctbal > 5000) AS DOUBLE) AS p FROM v_cust GROUP BY 1), b AS (SELECT r AS r0, p AS p0 FROM g WHERE s = 'AUTOMOBILE')
  SELECT s AS outcome, '(Intercept)' AS term, round(ln(p / p0), 5) AS b FROM g, b WHERE s <> 'AUTOMOBILE' UNION ALL SELECT s, 'rich', round(ln(r / r0) - ln(p / p0), 5) FROM g, b WHERE s <> 'AUTOMOBILE'""")
def multinomial_binary(spark, d):
    t = V.customers(spark, d).withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))
    return rounded(G.regression_multinomial(t, "c_mktsegment", "rich")["coefficients"].select("outcome", "term", "b"), 5)


@query("ordinal_regression")
def ordinal_regression(spark, d):
    return G.regression_ordinal(V.items(spark, d), "q1", "r1,r2")["coefficients"]


@query("ordinal_thresholds", f"""WITH {V.ITEMS}, c AS (SELECT q1, CAST(count(*) AS DOUBLE) AS n FROM v_items GROUP BY 1), p AS (SELECT q1, lead(q1) OVER (ORDER BY q1) AS nx, sum(n) OVER (ORDER BY q1) / sum(n) OVER () AS f FROM c)
  SELECT CAST(q1 AS VARCHAR) || ' | ' || CAST(nx AS VARCHAR) AS threshold, round(ln(f / (1 - f)), 4) AS tau FROM p WHERE nx IS NOT NULL""")
def ordinal_thresholds(spark, d):
    return rounded(G.regression_ordinal(V.items(spark, d), "q1")["thresholds"].select("threshold", "tau"), 4)


@query("followup_attrition", f"WITH {V.PAIRS} SELECT count(*) AS baseline, count(*) FILTER (y2 IS NOT NULL) AS complete, count(*) FILTER (y2 IS NULL) AS lost, round(avg(CASE WHEN y2 IS NULL THEN 0.0 ELSE 1.0 END), 6) AS retention_rate FROM v_pairs")
def followup_attrition(spark, d):
    return rounded(G.followup_attrition(V.pairs(spark, d), "y2")["status"])


@query("followup_attrition_model")
def followup_attrition_model(spark, d):
    return G.followup_attrition(V.pairs(spark, d).where("y1 is not null"), "y2", "k1")["coefficients"]


# ---------------------------------------------------------------- choice
@query("choice_diagnostics", f"""WITH {CHOICE}, s AS (SELECT respondent, task, sum(chosen) AS p FROM v_choice GROUP BY 1, 2)
  SELECT (SELECT count(DISTINCT respondent) FROM v_choice) AS respondents, (SELECT count(*) FROM v_choice) AS profile_rows, count(*) AS tasks, count(*) FILTER (p = 0) AS rejected, round(avg(CASE WHEN p = 0 THEN 1.0 ELSE 0.0 END), 6) AS reject_rate, count(*) FILTER (p > 1) AS invalid FROM s""")
def choice_diagnostics(spark, d):
    return rounded(CH.choice_diagnostics(choice_rows(spark, d), "flag,band", "chosen", "respondent")["summary"])


@query("choice_level_shares", f"WITH {CHOICE} SELECT 'band' AS attribute, band AS level, count(*) AS n, round(1.0 * count(*) / (SELECT count(*) FROM v_choice), 6) AS share FROM v_choice GROUP BY 2")
def choice_level_shares(spark, d):
    return rounded(CH.choice_diagnostics(choice_rows(spark, d), "band", "chosen", "respondent")["levels"])


@query("prepare_choice", f"""WITH {CHOICE}, o AS (SELECT respondent, task, band, chosen, 0 AS outside FROM v_choice UNION ALL SELECT respondent, task, '__OUTSIDE__', 1 - max(chosen), 1 FROM v_choice GROUP BY 1, 2)
  SELECT respondent || chr(31) || task AS set_id, CAST(chosen AS DOUBLE) AS y, CASE WHEN band = 'b_medium' THEN 1.0 ELSE 0.0 END AS x0, CASE WHEN band = 'c_large' THEN 1.0 ELSE 0.0 END AS x1, CAST(outside AS DOUBLE) AS x2 FROM o""")
def prepare_choice(spark, d):
    return CH.prepare_choice(choice_rows(spark, d), "band", "chosen", "respondent", "task", "alternative").data.drop("respondent", "grp")


@query("mnl")
def mnl(spark, d):
    return CH.mnl(choice_rows(spark, d), "flag,band", "chosen", "respondent", "task", "alternative", factor="urgency")["coefficients"]


@query("swait_louviere")
def swait_louviere(spark, d):
    return CH.swait_louviere(choice_rows(spark, d), "flag,band", "chosen", "respondent", "task", "alternative", factor="urgency")["test"]


@query("mixed_logit")
def mixed_logit(spark, d):
    return CH.mixed_logit(choice_rows(spark, d), "flag,band", "chosen", "respondent", "band=c_large", "task", "alternative")["coefficients"]


# ---------------------------------------------------------------- overlap weights
def arms(spark, d):
    """Market segments as arms, customers clustered by nation."""
    return V.customers(spark, d).where("mean_price is not null").withColumn("rich", (F.col("c_acctbal") > 5000).cast("int"))


# with one binary covariate the propensity model is saturated, so the scores are cell shares
_OW = f"""{V.CUSTOMERS}, a AS (SELECT *, c_acctbal > 5000 AS rich FROM v_cust WHERE mean_price IS NOT NULL),
  e AS (SELECT rich, c_mktsegment AS s, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rich) AS e FROM a GROUP BY 1, 2), h AS (SELECT rich, 1 / sum(1 / e) AS h FROM e GROUP BY 1),
  w AS (SELECT a.*, e.e, h.h / e.e AS w FROM a JOIN e ON e.rich = a.rich AND e.s = a.c_mktsegment JOIN h ON h.rich = a.rich)"""


@query("overlap_weights", f"WITH {_OW} SELECT c_custkey, round(e, 5) AS own_ps, round(w, 5) AS w FROM w")
def overlap_weights(spark, d):
    m = O.propensity(arms(spark, d).withColumn("id", F.col("c_custkey")), "c_mktsegment", "rich", cluster="id")
    return rounded(m.data.select(F.col("_g0").alias("c_custkey"), "own_ps", "w"), 5)


@query("ess_table", f"""WITH {_OW}, t AS (SELECT c_mktsegment AS arm, count(*) AS n, sum(w) * sum(w) / sum(w * w) AS ess, min(e) AS m, count(DISTINCT c_nationkey) AS f FROM w GROUP BY 1)
  SELECT arm, n, round(ess, 4) AS ess, round(m, 4) AS min_ps_own_arm, f AS firms FROM t UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), round(sum(ess), 4), NULL, (SELECT count(DISTINCT c_nationkey) FROM w) FROM t""")
def ess_table(spark, d):
    return rounded(O.ess_table(O.propensity(arms(spark, d), "c_mktsegment", "rich", "c_nationkey")), 4)


@query("balance_table", f"""WITH {_OW}, g AS (SELECT c_mktsegment, avg(CAST(rich AS INTEGER)) AS m, sum(w * CAST(rich AS INTEGER)) / sum(w) AS wm, var_samp(CAST(rich AS INTEGER)) AS v FROM w GROUP BY 1)
  SELECT 'rich' AS covariate, round((max(m) - min(m)) / sqrt(avg(v)), 4) AS max_smd_unweighted, round((max(wm) - min(wm)) / sqrt(avg(v)), 4) AS max_smd_weighted FROM g""")
def balance_table(spark, d):
    return rounded(O.balance_table(O.propensity(arms(spark, d), "c_mktsegment", "rich", "c_nationkey")), 4)


@query("estimability_gates")
def estimability_gates(spark, d):
    m = O.propensity(arms(spark, d), "c_mktsegment", "c_acctbal,n_orders", "c_nationkey")
    return O.estimability_gates(O.ess_table(m), O.balance_table(m))


@query("estimability_gates_binary", f"""WITH {_OW}, t AS (SELECT c_mktsegment AS arm, count(*) AS n, sum(w) * sum(w) / sum(w * w) AS ess, min(e) AS m, count(DISTINCT c_nationkey) AS f FROM w GROUP BY 1),
  g AS (SELECT c_mktsegment, sum(w * CAST(rich AS INTEGER)) / sum(w) AS wm, var_samp(CAST(rich AS INTEGER)) AS v FROM w GROUP BY 1)
  SELECT 'n[' || arm || ']' AS gate, CAST(n AS DOUBLE) AS value, n >= {O.DEFAULT_GATES['min_n_per_arm']} AS pass FROM t UNION ALL SELECT 'ess[' || arm || ']', round(ess, 4), ess >= {O.DEFAULT_GATES['min_ess_per_arm']} FROM t
  UNION ALL SELECT 'min_ps_own_arm[' || arm || ']', round(m, 4), m >= {O.DEFAULT_GATES['min_ps_own_arm']} FROM t UNION ALL SELECT 'firms[' || arm || ']', CAST(f AS DOUBLE), f >= {O.DEFAULT_GATES['min_firms_per_arm']} FROM t
  UNION ALL SELECT 'ess[total of arms used]', round(sum(ess), 4), sum(ess) >= {O.DEFAULT_GATES['min_ess_total']} FROM t
  UNION ALL SELECT 'max weighted smd', round((max(wm) - min(wm)) / sqrt(avg(v)), 4), (max(wm) - min(wm)) / sqrt(avg(v)) <= {O.DEFAULT_GATES['max_abs_smd']} FROM g""")
def estimability_gates_binary(spark, d):
    m = O.propensity(arms(spark, d), "c_mktsegment", "rich", "c_nationkey")
    return rounded(O.estimability_gates(O.ess_table(m), O.balance_table(m)), 4)


@query("overlap_means", f"WITH {_OW} SELECT c_mktsegment AS arm, round(sum(w * mean_price) / sum(w), 2) AS weighted_mean FROM w GROUP BY 1")
def overlap_means(spark, d):
    t = O.overlap_contrast(arms(spark, d), "c_mktsegment", "rich", "c_nationkey", "mean_price", "BUILDING-FURNITURE", force=True)["means"]
    return rounded(t.select("arm", "weighted_mean"), 2)


@query("overlap_contrast")
def overlap_contrast(spark, d):
    return O.overlap_contrast(arms(spark, d), "c_mktsegment", "c_acctbal,n_orders", "c_nationkey", "mean_price", "AUTOMOBILE:0.5,BUILDING:0.5,FURNITURE:-0.5,HOUSEHOLD:-0.5", force=True)["contrast"]


@query("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    return O.cluster_bootstrap(arms(spark, d), "c_mktsegment", "c_acctbal,n_orders", "c_nationkey", "mean_price", "BUILDING-FURNITURE")["summary"]


# ---------------------------------------------------------------- survival
def durations(spark, d):
    """Days from a customer's first to second order; customers with one order are censored at the last order date of all."""
    o = V.table(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f"), F.count(F.lit(1)).alias("n"))
    rest = o.join(per, "o_custkey").where(F.col("o_orderkey") != F.col("f.o_orderkey")).groupBy("o_custkey").agg(F.min("o_orderdate").alias("second"))
    last = o.agg(F.max("o_orderdate").alias("last"))
    t = per.join(rest, "o_custkey", "left").join(last, F.lit(True)).join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    end = F.coalesce("second", "last")
    return t.select("c_nationkey", (F.col("c_acctbal") / 1000).alias("bal"), F.col("f.o_orderkey").alias("k"), (F.datediff(end, "f.o_orderdate") + 1).cast("double").alias("days"),
                    F.col("second").isNotNull().cast("int").alias("event"))


DURATIONS = """r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders), dd AS (SELECT a.o_custkey, a.o_orderdate AS f, b.o_orderdate AS s FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.i = 2 WHERE a.i = 1),
  v_dur AS (SELECT o_custkey, datediff('day', f, coalesce(s, (SELECT max(o_orderdate) FROM orders))) + 1 AS days, s IS NOT NULL AS event FROM dd JOIN customer ON c_custkey = o_custkey)"""


@query("product_limit", f"""WITH {DURATIONS}, t AS (SELECT CAST(days AS DOUBLE) AS t, count(*) AS n, count(*) FILTER (event) AS events FROM v_dur GROUP BY 1), k AS (SELECT *, CAST(sum(n) OVER (ORDER BY t DESC) AS BIGINT) AS at_risk FROM t), e AS (SELECT * FROM k WHERE events > 0)
  SELECT t, at_risk, events, round(exp(sum(ln(greatest(1 - events * 1.0 / at_risk, 1e-300))) OVER (ORDER BY t)), 6) AS survival FROM e""")
def product_limit(spark, d):
    return rounded(SV.product_limit(durations(spark, d), "days", "event"))


@query("cox_ph")
def cox_ph(spark, d):
    return SV.cox_ph(durations(spark, d), "days", "event", "bal", cluster="c_nationkey")["coefficients"]


@query("cox_summary", f"""WITH {DURATIONS}, t AS (SELECT CAST(days AS DOUBLE) AS t, count(*) AS n, count(*) FILTER (event) AS events FROM v_dur GROUP BY 1), k AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM t), s AS (SELECT t, exp(sum(ln(greatest(1 - events * 1.0 / at_risk, 1e-300))) OVER (ORDER BY t)) AS s FROM k WHERE events > 0)
  SELECT (SELECT count(*) FROM v_dur) AS n, (SELECT count(*) FROM v_dur WHERE event) AS events, (SELECT count(*) FROM v_dur WHERE NOT event) AS censored, (SELECT min(t) FROM s WHERE s <= 0.5) AS median_survival""")
def cox_summary(spark, d):
    return SV.cox_ph(durations(spark, d), "days", "event", "bal")["model"].select("n", "events", "censored", "median_survival")
