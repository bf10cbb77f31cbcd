"""Descriptive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import columns as C
from tallyspark.operators import describe as D
from tallyspark.operators.order_stats import average_ranks, qq_table, unpivot_numeric
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded
from tallyspark.registry import run
from tallyspark.sources import tables as S

_DESCR = """count({x}) AS n, count(*) - count({x}) AS missing, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd,
  round(stddev_samp({x}) / sqrt(count({x})), 6) AS se_mean, min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS q1,
  round(quantile_cont({x}, 0.5), 6) AS median, round(quantile_cont({x}, 0.75), 6) AS q3, max({x}) AS max,
  round(skewness({x}), 6) AS skewness, round(kurtosis({x}), 6) AS kurtosis"""


def _descr_sql(variables, by=None):
    group = f"{by} AS \"group\", " if by else ""
    tail = f" WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""
    return f"WITH {V.LINES} " + " UNION ALL ".join(
        f"SELECT {group}'{x}' AS variable, {_DESCR.format(x=x)} FROM v_lines{tail}" for x in variables)


@query("descriptives_by_group", _descr_sql(["l_extendedprice", "l_quantity"], "l_returnflag"))
def descriptives_by_group(spark, d):
    return rounded(D.descriptives(V.lines(spark, d), ["l_extendedprice", "l_quantity"], by="l_returnflag"))


@query("descriptives", _descr_sql(["l_extendedprice", "l_quantity", "x_null"]))
def descriptives(spark, d):
    return rounded(D.descriptives(V.lines(spark, d), ["l_extendedprice", "l_quantity", "x_null"]))


@query("frequencies", f"""WITH {V.LINES}, t AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS level FROM v_lines
  UNION ALL SELECT 'x_null', CAST(x_null AS VARCHAR) FROM v_lines),
  c AS (SELECT variable, level, count(*) AS n FROM t GROUP BY 1, 2),
  s AS (SELECT variable, count(*) AS total, count(level) AS valid FROM t GROUP BY 1)
  SELECT variable, coalesce(level, 'Missing') AS level, n, round(100.0 * n / total, 6) AS percent,
    CASE WHEN level IS NOT NULL THEN round(100.0 * n / valid, 6) END AS valid_percent FROM c JOIN s USING (variable)
  UNION ALL SELECT variable, 'Total', total, 100.0, 100.0 FROM s""")
def frequencies(spark, d):
    return rounded(D.frequencies(V.lines(spark, d), "l_returnflag,x_null"))


@query("summary_numeric", f"""WITH {V.CUSTOMERS} """ + " UNION ALL ".join(
    f"""SELECT '{x}' AS variable, count({x}) AS n, count(*) - count({x}) AS missing, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd,
    min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS q1, round(quantile_cont({x}, 0.5), 6) AS median,
    round(quantile_cont({x}, 0.75), 6) AS q3, max({x}) AS max FROM v_cust""" for x in ("c_acctbal", "n_orders")))
def summary_numeric(spark, d):
    return rounded(D.summary(V.customers(spark, d), ["c_acctbal", "n_orders", "c_mktsegment"])["numeric"])


@query("summary_categorical", """SELECT 'c_mktsegment' AS variable, c_mktsegment AS level, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM customer GROUP BY c_mktsegment""")
def summary_categorical(spark, d):
    return rounded(D.summary(V.table(spark, d, "customer"), ["c_mktsegment"])["categorical"])


@query("summary_means_by", """SELECT c_mktsegment, 'c_acctbal' AS variable, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean,
  round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY 1""")
def summary_means_by(spark, d):
    return rounded(D.summary(V.table(spark, d, "customer"), ["c_acctbal"], by="c_mktsegment")["means_by"])


@query("columns_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_missing, count(DISTINCT {c}) AS \"distinct\" FROM orders"
    for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                 ("o_orderpriority", "string"))))
def columns_profile(spark, d):
    return D.columns_profile(V.table(spark, d, "orders"), "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority")


_GAPS = """v_gaps AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_discount END AS a, CASE WHEN l_quantity > 5 THEN l_tax END AS b,
  CASE WHEN l_returnflag = 'R' THEN '  ' ELSE l_returnflag END AS c FROM lineitem)"""


def _gaps(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("a"), F.when(F.col("l_quantity") > 5, F.col("l_tax")).alias("b"),
        F.when(F.col("l_returnflag") == "R", "  ").otherwise(F.col("l_returnflag")).alias("c"))


@query("missing_variables", f"""WITH {_GAPS} SELECT 'a' AS variable, count(*) - count(a) AS missing, round(100.0 * (count(*) - count(a)) / count(*), 6) AS percent FROM v_gaps
  UNION ALL SELECT 'b', count(*) - count(b), round(100.0 * (count(*) - count(b)) / count(*), 6) FROM v_gaps
  UNION ALL SELECT 'c', count(*) FILTER (WHERE trim(c) = ''), round(100.0 * count(*) FILTER (WHERE trim(c) = '') / count(*), 6) FROM v_gaps""")
def missing_variables(spark, d):
    return rounded(D.missing(_gaps(spark, d), "a,b,c")["variables"])


@query("missing_patterns", f"""WITH {_GAPS}, p AS (SELECT concat_ws(' + ', CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL THEN 'b' END,
  CASE WHEN trim(c) = '' THEN 'c' END) AS s FROM v_gaps)
  SELECT CASE WHEN s = '' THEN '(complete)' ELSE s END AS pattern, count(*) AS n FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def missing_patterns(spark, d):
    return D.missing(_gaps(spark, d), "a,b,c")["patterns"]


@query("crosstab_counts", """SELECT coalesce(l_returnflag, 'Total') AS "row", coalesce(l_linestatus, 'Total') AS "col", count(*) AS n
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab_counts(spark, d):
    return D.crosstabs(V.lines(spark, d), "l_returnflag", "l_linestatus")["counts"]


@query("crosstab_row_percent", """SELECT o_orderpriority AS "row", o_orderstatus AS "col",
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS row_percent FROM orders GROUP BY 1, 2""")
def crosstab_row_percent(spark, d):
    return rounded(D.crosstabs(V.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")["row_percent"])


_GRID = """c AS (SELECT {r} AS r, {c} AS k, count(*) AS n FROM {t} WHERE {r} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2),
  g AS (SELECT a.r, b.k, coalesce(c.n, 0) AS n, a.rn * b.cn * 1.0 / s.t AS e, s.t FROM (SELECT r, sum(n)::DOUBLE AS rn FROM c GROUP BY 1) a
    CROSS JOIN (SELECT k, sum(n)::DOUBLE AS cn FROM c GROUP BY 1) b CROSS JOIN (SELECT sum(n)::DOUBLE AS t FROM c) s
    LEFT JOIN c ON c.r = a.r AND c.k = b.k)"""


@query("crosstab_chi2", f"""WITH {_GRID.format(r='l_returnflag', c='l_linestatus', t='lineitem')},
  x AS (SELECT CAST(max(t) AS BIGINT) AS n, count(DISTINCT r) AS rows, count(DISTINCT k) AS cols, sum((n - e) ** 2 / e) AS x2,
   2 * sum(CASE WHEN n > 0 THEN n * ln(n / e) ELSE 0 END) AS g2, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS low FROM g)
  SELECT n, (rows - 1) * (cols - 1) AS df, round(x2, 6) AS chi_square, round(g2, 5) AS likelihood_ratio,
    round(sqrt(x2 / (n * (least(rows, cols) - 1))), 6) AS cramers_v, low AS low_expected_share FROM x""")
def crosstab_chi2(spark, d):
    t = D.crosstabs(V.lines(spark, d), "l_returnflag", "l_linestatus")["tests"]
    return rounded(t.select("n", "df", "chi_square", F.round("likelihood_ratio", 5).alias("likelihood_ratio"), "cramers_v", "low_expected_share"))


@query("crosstab_yates", f"""WITH {_GRID.format(r='quality', c='toxic', t='labels')}
  SELECT CAST(max(t) AS BIGINT) AS n, round(sum((n - e) ** 2 / e), 6) AS chi_square,
   round(sum(greatest(abs(n - e) - least(0.5, abs(n - e)), 0) ** 2 / e), 6) AS yates FROM g""")
def crosstab_yates(spark, d):
    return rounded(D.crosstabs(V.table(spark, d, "labels"), "quality", "toxic")["tests"].select("n", "chi_square", "yates"))


@query("n_pairwise", f"WITH {V.LINES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM v_lines"
    for a in ("l_discount", "x_null") for b in ("l_discount", "x_null")))
def n_pairwise(spark, d):
    return D.pairwise_counts(V.lines(spark, d), "l_discount,x_null")


@query("value_counts", """WITH k(position, category) AS (VALUES (0, 'O'), (1, 'F'), (2, 'P'), (3, 'X'))
  SELECT position, category, (SELECT count(*) FROM orders WHERE o_orderstatus = category) AS n FROM k""")
def value_counts(spark, d):
    return D.value_counts(V.table(spark, d, "orders"), "o_orderstatus", ["O", "F", "P", "X"])


@query("cumulative_share", """WITH c AS (SELECT l_shipdate AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1), m AS (
  SELECT date_trunc('year', day) AS y, sum(q) AS q FROM c GROUP BY 1)
  SELECT CAST(year(y) AS INTEGER) AS ship_year, q AS quantity, round(q / sum(q) OVER (), 6) AS share, round(sum(q) OVER (ORDER BY y) / sum(q) OVER (), 6) AS cumulative_share FROM m""")
def cumulative_share(spark, d):
    t = V.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("ship_year")).agg(F.sum("l_quantity").alias("quantity"))
    return rounded(D.cumulative_share(t, "quantity", ["ship_year"]))


@query("distinct_within", """SELECT o_custkey, count(*) AS rows, count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities
  FROM orders GROUP BY 1""")
def distinct_within(spark, d):
    return D.distinct_within(V.table(spark, d, "orders"), ["o_custkey"], {"statuses": "o_orderstatus", "priorities": "o_orderpriority"})


@query("mode_per_group", """WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT o_custkey, v AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS r FROM c) WHERE r = 1""")
def mode_per_group(spark, d):
    return D.mode_per_group(V.table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("first_non_null", f"""WITH {V.ORDERED_LINES}, f AS (SELECT l_orderkey, ln, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag,
    CASE WHEN l_linenumber > 2 THEN l_tax END AS tax FROM v_ol)
  SELECT l_orderkey, arg_min(flag, ln) FILTER (WHERE flag IS NOT NULL) AS flag, arg_min(tax, ln) FILTER (WHERE tax IS NOT NULL) AS tax FROM f GROUP BY 1""")
def first_non_null(spark, d):
    t = V.ordered_lines(spark, d).select(
        "l_orderkey", "ln", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"), F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("tax"))
    return D.first_non_null(t, ["l_orderkey"], ["flag", "tax"], "ln")


@query("average_ranks", """SELECT l_returnflag, l_quantity AS value, n, before, rank FROM (
  SELECT l_returnflag, l_quantity, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) AS BIGINT) AS before,
   sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - count(*) + (count(*) + 1) / 2.0 AS rank FROM lineitem GROUP BY 1, 2)""")
def average_ranks_query(spark, d):
    return average_ranks(V.table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).select("l_returnflag", "value", "n", "before", "rank")


_P9 = [i / 10 for i in range(1, 10)]


@query("qq_quantiles", " UNION ALL ".join(f"SELECT {p} AS p, round(quantile_cont(o_totalprice, {p}), 6) AS sample_quantile FROM orders" for p in _P9))
def qq_quantiles(spark, d):
    t = qq_table(V.table(spark, d, "orders"), "o_totalprice", points=9)["qq"]
    return rounded(t.select("p", "sample_quantile"))


@query("unpivot_numeric", """SELECT c_custkey, 'c_acctbal' AS variable, c_acctbal AS value FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer""")
def unpivot(spark, d):
    return unpivot_numeric(V.table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], ["c_custkey"])


@query("numeric_coercion", """SELECT o_orderstatus, count(*) AS rows, count(try_cast(split_part(o_orderpriority, '-', 1) || CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END AS DOUBLE)) AS readable
  FROM orders GROUP BY 1""")
def numeric_coercion(spark, d):
    o = V.table(spark, d, "orders").withColumn(
        "raw", F.concat(F.substring_index("o_orderpriority", "-", 1), F.when(F.col("o_orderstatus") == "P", "x").otherwise("")))
    return C.numeric(o, ["raw"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.count("raw").alias("readable"))


@query("normalize_text", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def normalize_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", C.normalize_text("text").alias("text"))


@query("canonicalize", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN
   CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' ELSE '3-Medium' END ELSE '' END AS o_orderpriority FROM orders""")
def canonicalize(spark, d):
    fixed, _ = C.canonicalize(V.table(spark, d, "orders"), "o_orderpriority", ["1-Urgent", "2-High", "3-Medium"], "o_orderkey")
    return fixed.select("o_orderkey", "o_orderpriority")


@query("canonicalize_problems", """SELECT 'ERROR' AS level, CAST(o_orderkey AS VARCHAR) AS "where",
  '''o_orderpriority'' = ''' || o_orderpriority || ''' is not one of: 1-Urgent, 2-High, 3-Medium' AS problem FROM orders
  WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def canonicalize_problems(spark, d):
    return C.canonicalize(V.table(spark, d, "orders"), "o_orderpriority", ["1-Urgent", "2-High", "3-Medium"], "o_orderkey")[1]


@query("canonical_loose", """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '4 Not specified' WHEN o_orderpriority = '5-LOW' THEN '5 Low' END AS priority FROM orders""")
def canonical_loose(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.canonical_loose("o_orderpriority", ["4 Not specified", "5 Low"]).alias("priority"))


@query("split_list", "SELECT page_id, array_to_string([trim(x) FOR x IN regexp_split_to_array(url, '[;,]') IF trim(x) <> ''], '|') AS parts FROM pages")
def split_list(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.array_join(C.split_list("url"), "|").alias("parts"))


@query("alias_values", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'rush' WHEN '2-HIGH' THEN 'rush' ELSE lower(o_orderpriority) END AS clock FROM orders""")
def alias_values(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.alias_value("o_orderpriority", {"1-urgent": "rush", "2-high": "rush"}).alias("clock"))


@query("reverse_score", f"WITH {V.ITEMS} SELECT vec_id, 6 - q1 AS q1 FROM v_items")
def reverse_score(spark, d):
    return V.items(spark, d).select("vec_id", C.reverse_score("q1", 1, 5).alias("q1"))


@query("dummy_encode", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END AS "c_mktsegment=BUILDING",
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0 ELSE 0.0 END AS "c_mktsegment=FURNITURE", CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0 ELSE 0.0 END AS "c_mktsegment=HOUSEHOLD",
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END AS "c_mktsegment=MACHINERY" FROM customer""")
def dummy_encode(spark, d):
    c = V.table(spark, d, "customer")
    return c.select("c_custkey", *[e.alias(n) for n, e in C.dummy_columns("c_mktsegment", C.text_levels(c, "c_mktsegment")).items()])


@query("first_difference", f"WITH {V.PAIRS} SELECT o_custkey, round(y2 - y1, 6) AS y, k2 - k1 AS k FROM v_pairs")
def first_difference(spark, d):
    return rounded(V.pairs(spark, d).select("o_custkey", *[e.alias(n) for n, e in C.first_difference({"y": ("y1", "y2"), "k": ("k1", "k2")}).items()]))


@query("fuzzy_calibrate", f"WITH {V.FUZZY} SELECT c_custkey, round(rich, 6) AS rich, round(busy, 6) AS busy, round(settled, 6) AS settled, round(dear, 6) AS dear FROM v_fuzzy")
def fuzzy_calibrate(spark, d):
    return rounded(V.fuzzy(spark, d))


_DATES = {
    0: ("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"),
    1: ("strftime(o_orderdate, '%d.%m.%Y')", "date_format(o_orderdate, 'dd.MM.yyyy')"),
    2: ("strftime(o_orderdate, '%Y. %m. %d.')", "date_format(o_orderdate, 'yyyy. MM. dd.')"),
    3: ("CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)", "cast(datediff(o_orderdate, date'1899-12-30') as string)"),
    4: ("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')"),
    5: ("strftime(o_orderdate, '%Y-%m-%d') || ' 12:30+02:00'", "concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 12:30+02:00')"),
    6: ("''", "''"),
}


@query("parse_days", """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN NULL WHEN 6 THEN NULL
    ELSE round(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + CASE WHEN o_orderkey % 7 = 5 THEN 10.5 / 24 ELSE 0 END, 6) END AS days,
  o_orderkey % 7 = 4 AS rejected FROM orders""")
def parse_days(spark, d):
    from tallyspark.functions.dates import days_problem, parse_days as pd_

    raw = "case o_orderkey % 7 " + " ".join(f"when {k} then {v[1]}" for k, v in _DATES.items()) + " end as raw"
    o = V.table(spark, d, "orders").selectExpr("o_orderkey", raw)
    return rounded(o.select("o_orderkey", pd_("raw").alias("days"), days_problem("raw").isNotNull().alias("rejected")))


@query("interval_normalize", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_quantity, l_linenumber * 10) * f AS low, greatest(l_quantity, l_linenumber * 10) * f AS high
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 7.0 WHEN 'N' THEN 1.0 ELSE 30.4375 END AS f FROM lineitem)""")
def interval_normalize(spark, d):
    t = V.table(spark, d, "lineitem").withColumn("unit", F.when(F.col("l_returnflag") == "A", "Weeks").when(F.col("l_returnflag") == "N", " days").otherwise("month"))
    a, b, f = F.col("l_quantity"), F.col("l_linenumber") * 10.0, C.unit_days("unit")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.interval_low(a, b, f).alias("low"), C.interval_high(a, b, f).alias("high"))


@query("registry_run", """SELECT variable, level, n, round(100.0 * n / (SELECT count(*) FROM orders), 6) AS percent FROM (
  SELECT 'o_orderstatus' AS variable, o_orderstatus AS level, count(*) AS n FROM orders GROUP BY 2
  UNION ALL SELECT 'o_orderstatus', 'Total', count(*) FROM orders)""")
def registry_run(spark, d):
    return rounded(run("frequencies", V.table(spark, d, "orders"), {"variables": "o_orderstatus"})["frequencies"].drop("valid_percent"))


@query("run_manifest")
def run_manifest(spark, d):
    o = V.table(spark, d, "orders")
    out = D.frequencies(o, "o_orderstatus")
    return S.run_manifest(spark, "frequencies", {"variables": "o_orderstatus"}, {"orders": o}, {"frequencies": out}).drop("created_at")
