"""Evidence bounds and critical-path verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import bounds as B
from tallyspark.operators import network as N
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded

# ---------------------------------------------------------------- evidence intervals
_GRADE = "['A', 'B', 'C', 'D', 'E', 'S', 'I']"


def evidence(spark, d):
    """Per part: four parameters, graded by supplier, with an interval around the line price."""
    grade = F.element_at(F.array(*[F.lit(g) for g in B.LADDER]), (F.col("l_suppkey") % 7 + 1).cast("int"))
    return V.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("case_id"), F.concat(F.lit("p"), F.col("l_linenumber") % 4).alias("parameter"), grade.alias("grade"),
        (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("low"), (F.col("l_extendedprice") + F.col("l_quantity") * 1000).alias("high"))


EVIDENCE = f"""v_ev AS (SELECT l_partkey AS case_id, 'p' || (l_linenumber % 4) AS parameter, {_GRADE}[l_suppkey % 7 + 1] AS grade,
  min(l_extendedprice - l_quantity * 1000) AS low, max(l_extendedprice + l_quantity * 1000) AS high FROM lineitem GROUP BY 1, 2, 3)"""


def _admit_sql(source="v_ev", keys="case_id, parameter"):
    """Chained CTEs, one per rung of the ladder."""
    parts = [f"k AS (SELECT DISTINCT {keys} FROM {source})", f"s0 AS (SELECT {keys}, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM k)"]
    for i, g in enumerate(B.LADDER, 1):
        parts.append(f"""s{i} AS (SELECT {keys}, '{g}' AS rung, coalesce(lo <= hi AND greatest(lo, low) > least(hi, high), false) AS conflict, low AS given_low, high AS given_high,
          CASE WHEN low IS NULL OR coalesce(greatest(lo, low) > least(hi, high), false) AND lo IS NOT NULL THEN lo WHEN lo IS NULL THEN low ELSE greatest(lo, low) END AS lo,
          CASE WHEN low IS NULL OR coalesce(greatest(lo, low) > least(hi, high), false) AND lo IS NOT NULL THEN hi WHEN lo IS NULL THEN high ELSE least(hi, high) END AS hi
          FROM s{i - 1} LEFT JOIN (SELECT * FROM {source} WHERE grade = '{g}') USING ({keys}))""")
    return ", ".join(parts)


_ALL = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, 8))


@query("admit_intervals", f"WITH {EVIDENCE}, {_admit_sql()} SELECT case_id, parameter, rung, round(lo, 6) AS low, round(hi, 6) AS high, conflict FROM ({_ALL})")
def admit_intervals(spark, d):
    return rounded(B.admit_intervals(evidence(spark, d), ["case_id", "parameter"]).select("case_id", "parameter", "rung", "low", "high", "conflict"))


@query("admission_conflicts", f"""WITH {EVIDENCE}, {_admit_sql()} SELECT case_id, parameter, rung AS grade, round(lo, 6) AS kept_low, round(hi, 6) AS kept_high,
  round(given_low, 6) AS rejected_low, round(given_high, 6) AS rejected_high FROM ({_ALL}) WHERE conflict""")
def admission_conflicts(spark, d):
    return rounded(B.admission_conflicts(B.admit_intervals(evidence(spark, d), ["case_id", "parameter"]), ["case_id", "parameter"]))


@query("survey_interval_mean", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice) - 1.959964 * stddev_samp(o_totalprice) / sqrt(count(*)), 5) AS low,
  round(avg(o_totalprice) + 1.959964 * stddev_samp(o_totalprice) / sqrt(count(*)), 5) AS high FROM orders GROUP BY 1""")
def survey_interval_mean(spark, d):
    return rounded(B.survey_interval(V.table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), 5)


@query("survey_interval_percentile", """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT o_orderpriority, max(n) AS n, max(o_totalprice) FILTER (i = floor(0.1 * (n - 1) + 0.5)) AS low, max(o_totalprice) FILTER (i = floor(0.9 * (n - 1) + 0.5)) AS high FROM r GROUP BY 1""")
def survey_interval_percentile(spark, d):
    return B.survey_interval(V.table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], method="p10p90")


_BOXES = f"""{EVIDENCE}, {_admit_sql()}, al AS ({_ALL}), bx AS (SELECT case_id, rung, {', '.join(f"max(lo) FILTER (parameter = 'p{i}') AS l{i}, max(hi) FILTER (parameter = 'p{i}') AS h{i}" for i in range(4))} FROM al GROUP BY 1, 2)"""
_F = "a - 0.5 * b + (c - d0) / 10"


@query("bounds", f"""WITH {_BOXES}, e AS (SELECT case_id, rung, unnest([{', '.join('l0 + 0 * h0' if False else _F.replace('a', 'xa', 1).replace('xa', ('l0', 'h0')[k & 1]).replace(' b ', f" {('l1', 'h1')[k >> 1 & 1]} ").replace('(c ', f"({('l2', 'h2')[k >> 2 & 1]} ").replace('d0)', f"{('l3', 'h3')[k >> 3 & 1]})") for k in range(16))}]) AS v FROM bx),
  m AS (SELECT case_id, rung, min(v) AS lo, max(v) AS hi, bool_or(v IS NULL) AS miss FROM e GROUP BY 1, 2)
  SELECT case_id, rung, CASE WHEN NOT miss THEN round(lo, 5) END AS low, CASE WHEN NOT miss THEN round(hi, 5) END AS high,
   CASE WHEN miss THEN 'NOT IDENTIFIED' WHEN hi < 20000 THEN 'below threshold favoured' WHEN lo > 20000 THEN 'above threshold favoured' ELSE 'assumption-sensitive' END AS status FROM m""")
def bounds(spark, d):
    t = B.bounds(evidence(spark, d), "case_id", "p0 - 0.5 * p1 + (p2 - p3) / q", ["p0", "p1", "p2", "p3"], fixed={"q": 10}, threshold=20000)["rungs"]
    return rounded(t.select("case_id", "rung", "low", "high", "status"), 5)


@query("breakdown_value", f"""WITH {_BOXES}, f AS (SELECT * FROM bx WHERE rung = 'I' AND l0 IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL)
  SELECT case_id, round(20000 + 0.5 * l1 - (h2 - l3) / 10, 4) AS value, 1 AS crossings, coalesce(20000 + 0.5 * l1 - (h2 - l3) / 10 BETWEEN l0 AND h0, false) AS inside_admitted_range FROM f""")
def breakdown_value(spark, d):
    t = B.bounds(evidence(spark, d), "case_id", "p0 - 0.5 * p1 + (p2 - p3) / q", ["p0", "p1", "p2", "p3"], fixed={"q": 10}, threshold=20000, breakdown_parameter="p0")["breakdown"]
    return rounded(t.select("case_id", "value", "crossings", "inside_admitted_range"), 4)


def route_tables(spark, d):
    ol = V.ordered_lines(spark, d)
    st = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise(F.when(F.col("o_orderpriority") == "1-URGENT", "refused").otherwise("screened_out"))
    routes = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("route"), st.alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", 60.0).alias("window_low"), F.when(F.col("o_orderpriority") == "2-HIGH", 90.0).alias("window_high"),
        F.when(F.col("o_orderstatus") == "O", F.floor(F.col("o_totalprice") / 5000).cast("double")).alias("elapsed"))
    q = F.col("l_quantity")
    stages = ol.select(F.col("l_orderkey").alias("route"), F.concat(F.lit("s"), "ln").alias("stage"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("S")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("grade"),
                       F.when(F.col("l_discount") > 0, q / 2).alias("low"), F.when(F.col("l_discount") > 0, q).alias("high"))
    totals = V.table(spark, d, "orders").where("o_orderpriority = '3-MEDIUM'").select(F.col("o_orderkey").alias("route"), F.lit("E").alias("grade"), F.lit(20.0).alias("low"), F.lit(80.0).alias("high"))
    return routes, stages, totals


ROUTES = f"""{V.ORDERED_LINES}, sm AS (SELECT l_orderkey AS route, bool_and(l_discount > 0) AS complete, sum(l_quantity / 2) AS sl, sum(l_quantity) AS sh FROM v_ol GROUP BY 1),
  rt AS (SELECT o_orderkey AS route, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'refused' ELSE 'screened_out' END END AS status,
   CASE WHEN o_orderpriority <> '5-LOW' THEN 60.0 END AS wl, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 90.0 ELSE 60.0 END AS wh,
   CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice / 5000) END AS el, CASE WHEN complete THEN sl END AS l0, CASE WHEN complete THEN sh END AS h0,
   CASE WHEN o_orderpriority = '3-MEDIUM' THEN 20.0 END AS tl, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 80.0 END AS th FROM orders LEFT JOIN sm ON sm.route = o_orderkey),
  r1 AS (SELECT *, coalesce(l0 IS NOT NULL AND tl IS NOT NULL AND greatest(l0, tl) > least(h0, th), false) AS tc FROM rt),
  r2 AS (SELECT *, CASE WHEN tc THEN l0 ELSE greatest(l0, tl) END AS l1, CASE WHEN tc THEN h0 ELSE least(h0, th) END AS h1 FROM r1),
  r3 AS (SELECT *, coalesce(status = 'pending' AND h1 < el, false) AS cc FROM r2),
  r4 AS (SELECT *, CASE WHEN status = 'pending' AND (l1 IS NULL OR cc) THEN el WHEN status = 'pending' THEN greatest(l1, el) ELSE l1 END AS lo, CASE WHEN status = 'pending' AND (l1 IS NULL OR cc) THEN 365.0 ELSE h1 END AS hi FROM r3),
  r5 AS (SELECT *, CASE WHEN status = 'refused' THEN 'not usable' WHEN lo IS NULL OR wl IS NULL THEN 'not identified' WHEN hi <= wl THEN 'surely on time' WHEN lo > wh THEN 'surely late' ELSE 'undetermined' END AS label FROM r4)"""


@query("latency_bounds", f"WITH {ROUTES} SELECT route, status, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, label, CAST(wl - hi AS DOUBLE) AS margin_low, CAST(wh - lo AS DOUBLE) AS margin_high, status = 'screened_out' AS ex_ante, tc AS total_clash, cc AS censor_clash FROM r5")
def latency_bounds(spark, d):
    return B.latency_bounds(*route_tables(spark, d))["routes"]


@query("latency_labels", f"WITH {ROUTES} SELECT label, count(*) AS routes FROM r5 GROUP BY 1")
def latency_labels(spark, d):
    return B.latency_bounds(*route_tables(spark, d))["counts"]


@query("manski_share_bounds", f"""WITH {ROUTES}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 'surely on time') AS DOUBLE) AS a, CAST(count(*) FILTER (label IN ('surely on time', 'undetermined', 'not identified')) AS DOUBLE) AS b, 1.959964 AS z FROM r5)
  SELECT CAST(n AS BIGINT) AS routes, round(a / n, 6) AS lower, round(b / n, 6) AS upper, round((a / n + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(a / n * (1 - a / n) / n + z * z / (4 * n * n)), 6) AS lower_wilson_low FROM s""")
def manski_share_bounds(spark, d):
    return rounded(B.latency_bounds(*route_tables(spark, d))["share"].select("routes", "lower", "upper", "lower_wilson_low"))


# ---------------------------------------------------------------- networks
_CLOCKS = ("Funding", "payment", "production", "Transport", "set-up")
_CLEAN = ("finance", "payment", "fulfilment", "logistics", "operational-readiness")


def network(spark, d, ol=None):
    """Orders as episodes and their lines as steps; low-priority partial orders have steps but no episode row."""
    ol = V.ordered_lines(spark, d) if ol is None else ol
    last = ol.groupBy("l_orderkey").agg(F.max("ln").alias("last_ln"), F.max("l_shipdate").alias("last_ship"), F.min("l_shipdate").alias("first_ship"))
    o = V.table(spark, d, "orders").where("not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')")
    tw = F.expr("timestampadd(DAY, cast((o_orderkey % 5 - 3) * 100 as int), last_ship)")
    ep = o.join(last, o.o_orderkey == last.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("episode"), F.expr("timestampadd(DAY, -20, first_ship)").alias("anchor_earliest"), F.lit(None).cast("timestamp").alias("anchor_latest"),
        tw.alias("tw_earliest"), F.expr("timestampadd(DAY, cast((o_orderkey % 5 - 3) * 100 + (o_orderkey % 3) * 40 as int), last_ship)").alias("tw_latest"),
        F.concat(F.lit("s"), F.coalesce("last_ln", F.lit(0))).alias("r_step"))
    prev = lambda k: F.concat(F.lit("s"), F.col("ln") - k)
    preds = F.when(F.col("ln") == 1, "").when((F.col("ln") % 3 == 0), F.concat(prev(1), F.lit("; "), prev(2))).otherwise(prev(1))
    q = F.col("l_quantity")
    exp = F.when(q == 1, -1.0).when(q == 2, 0.0).when(F.col("l_discount") > 0, q / 10)
    clock = F.element_at(F.array(*[F.lit(c) for c in _CLOCKS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    st = ol.select(F.col("l_orderkey").cast("string").alias("episode"), F.concat(F.lit("s"), "ln").alias("step"), clock.alias("clock"), preds.alias("predecessors"),
                   F.col("l_shipdate").alias("finish_earliest"), F.when(F.col("l_tax") > 0.06, F.expr("timestampadd(DAY, 2, l_shipdate)")).alias("finish_latest"), exp.alias("expected_days"),
                   F.when(F.col("l_returnflag") == "A", "Yes").alias("zero_documented"))
    return ep, st


_DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"
NETWORK = f"""{V.ORDERED_LINES}, la AS (SELECT l_orderkey, max(ln) AS last_ln, max(l_shipdate) AS last_ship, min(l_shipdate) AS first_ship FROM v_ol GROUP BY 1),
  v_ep AS (SELECT o_orderkey AS k, last_ln, {_DAY.format('first_ship')} - 20 AS anchor, {_DAY.format('last_ship')} + (o_orderkey % 5 - 3) * 100 AS tw_lo, {_DAY.format('last_ship')} + (o_orderkey % 5 - 3) * 100 + (o_orderkey % 3) * 40 AS tw_hi
   FROM orders LEFT JOIN la ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')),
  v_st AS (SELECT l_orderkey AS k, ln, ['finance', 'payment', 'fulfilment', 'logistics', 'operational-readiness'][l_linenumber % 5 + 1] AS clock, l_linenumber % 5 AS ci, {_DAY.format('l_shipdate')} AS f_lo,
   {_DAY.format('l_shipdate')} + CASE WHEN l_tax > 0.06 THEN 2 ELSE 0 END AS f_hi, l_quantity = 1 AS neg, l_quantity = 2 AND l_returnflag <> 'A' AS zero_gone,
   CASE WHEN l_quantity = 1 THEN -1.0 WHEN l_quantity = 2 THEN CASE WHEN l_returnflag = 'A' THEN 0.0 END WHEN l_discount > 0 THEN l_quantity / 10 END AS exp FROM v_ol),
  v_rd AS (SELECT s.*, CASE WHEN ln = 1 THEN anchor WHEN ln % 3 = 0 THEN greatest(lag(f_lo) OVER w, lag(f_lo, 2) OVER w) ELSE lag(f_lo) OVER w END AS ready_lo,
   CASE WHEN ln = 1 THEN anchor WHEN ln % 3 = 0 THEN greatest(lag(f_hi) OVER w, lag(f_hi, 2) OVER w) ELSE lag(f_hi) OVER w END AS ready_hi FROM v_st s JOIN v_ep USING (k) WINDOW w AS (PARTITION BY s.k ORDER BY ln)),
  v_real AS (SELECT *, greatest(f_lo - ready_lo, 0) AS real_lo, greatest(f_hi - ready_hi, 0) AS real_hi FROM v_rd)"""


def _typed(spark, d, **kw):
    labels, synonyms = N.clock_set()
    return N.read_episodes(*network(spark, d), labels, synonyms, **kw), labels


@query("realised_durations", f"WITH {NETWORK} SELECT CAST(k AS VARCHAR) AS episode, 's' || ln AS step, clock, CAST(ready_lo AS DOUBLE) AS ready_lo, CAST(ready_hi AS DOUBLE) AS ready_hi, CAST(real_lo AS DOUBLE) AS real_lo, CAST(real_hi AS DOUBLE) AS real_hi FROM v_real")
def realised_durations(spark, d):
    (ep, st, _, _), _ = _typed(spark, d)
    return N.realised_durations(ep, st).select("episode", "step", "clock", "ready_lo", "ready_hi", "real_lo", "real_hi")


@query("validate_episodes", f"""WITH {NETWORK} SELECT CAST(k AS VARCHAR) AS episode, 'step s' || ln || ': negative expected duration' AS problem FROM v_st WHERE neg""")
def validate_episodes(spark, d):
    (_, _, problems, _), _ = _typed(spark, d)
    return problems


@query("zero_duration_rule", f"""WITH {NETWORK} SELECT CAST(k AS VARCHAR) AS episode, 'step s' || ln || ': ex-ante duration 0 without zero_documented = Yes, treated as missing' AS note FROM v_st WHERE zero_gone""")
def zero_duration_rule(spark, d):
    (_, _, _, notes), _ = _typed(spark, d)
    return notes


@query("topological_levels", f"WITH {NETWORK} SELECT CAST(k AS VARCHAR) AS episode, 's' || ln AS step, CAST(ln - 1 AS INTEGER) AS level FROM v_st JOIN v_ep USING (k)")
def topological_levels(spark, d):
    (ep, st, _, _), labels = _typed(spark, d)
    return N.propagate(ep, st, sorted(labels)).select("episode", "step", "level")


_SUBS = N.scenarios(_CLEAN)
_SC = ", ".join(f"({i}, {N._mask(s, _CLEAN)}, {len(s)}, '{' + '.join(s)}')" for i, s in enumerate(_SUBS))
_BIT = "CASE clock " + " ".join(f"WHEN '{c}' THEN {1 << i}" for i, c in enumerate(sorted(_CLEAN))) + " END"
_VERDICT_CTE = f"""{NETWORK}, RECURSIVE_MARK
  vd AS (SELECT k, b, CASE b WHEN 0 THEN tw_lo ELSE tw_hi END - f AS slack, s, name, size FROM fin JOIN v_ep USING (k) JOIN sc USING (s) WHERE ln = last_ln),
  pc AS (SELECT k, list_sort(list(DISTINCT clock)) AS clocks, list_sort(coalesce(list(DISTINCT clock) FILTER (NOT ok), [])) AS un, bool_or(clock = 'finance') AS has_fin, bool_and(ln = 1 OR exp IS NOT NULL) AS lf_ok, bool_or(neg) AS bad FROM
     (SELECT *, bool_and(exp IS NOT NULL) OVER (PARTITION BY k, clock) AS ok FROM v_st) GROUP BY 1),
  g AS (SELECT k, b, max(slack) FILTER (size = 0) AS base, list(name ORDER BY s) FILTER (size = 1 AND list_contains(clocks, name) AND NOT list_contains(un, name) AND slack >= -1e-9) AS singles,
     max(slack) FILTER (size = 1 AND list_contains(clocks, name) AND NOT list_contains(un, name) AND slack >= -1e-9) AS s1, list(name ORDER BY s) FILTER (size = 2 AND len(list_intersect(clocks, string_split(name, ' + '))) = 2 AND slack >= -1e-9) AS prs,
     max(slack) FILTER (size = 2 AND len(list_intersect(clocks, string_split(name, ' + '))) = 2 AND slack >= -1e-9) AS s2, max(slack) FILTER (size = 5) AS s5, any_value(clocks) AS clocks, any_value(un) AS un FROM vd JOIN pc USING (k) GROUP BY 1, 2),
  v AS (SELECT k, b, base, CASE WHEN base >= -1e-9 THEN 'Non-binding' WHEN len(singles) = 1 THEN upper(singles[1][1]) || singles[1][2:] || '-binding' WHEN len(singles) > 1 THEN 'Multiple sufficient corrections' WHEN len(un) > 0 THEN 'Indeterminate'
     WHEN len(prs) > 0 OR (len(clocks) > 2 AND s5 >= -1e-9) THEN 'Jointly binding' ELSE 'Window infeasible at ex-ante durations' END AS verdict,
    CASE WHEN base >= -1e-9 THEN '' WHEN len(singles) > 0 THEN array_to_string(singles, '; ') WHEN len(un) > 0 THEN '' WHEN len(prs) > 0 THEN array_to_string(prs, '; ') WHEN len(clocks) > 2 AND s5 >= -1e-9 THEN array_to_string(clocks, ' + ') ELSE '' END AS bc,
    CASE WHEN base >= -1e-9 THEN base WHEN len(singles) > 0 THEN s1 WHEN len(un) > 0 THEN base WHEN len(prs) > 0 THEN s2 ELSE s5 END AS dec FROM g),
  w AS (SELECT a.k, a.verdict AS v0, z.verdict AS v1, a.bc AS c0, z.bc AS c1, a.dec AS d0, z.dec AS d1, a.base AS b0, z.base AS b1 FROM v a JOIN v z ON a.k = z.k AND a.b = 0 AND z.b = 1),
  ff AS (SELECT k, ln, clock, f_lo, f_hi, tw_lo - coalesce(sum(exp) OVER (PARTITION BY k ORDER BY ln DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lf_lo, tw_hi - coalesce(sum(exp) OVER (PARTITION BY k ORDER BY ln DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lf_hi FROM v_st JOIN v_ep USING (k)),
  fs AS (SELECT k, min(lf_lo - f_lo) FILTER (clock = 'finance') AS f0, min(lf_hi - f_hi) FILTER (clock = 'finance') AS f1 FROM ff GROUP BY 1),
  fv AS (SELECT CAST(e.k AS VARCHAR) AS episode, last_ln IS NULL AS nosteps, coalesce(bad, false) AS bad, v0 = v1 AND c0 = c1 AS stable, v0, c0, d0, d1, b0, b1, CASE WHEN lf_ok THEN f0 END AS f0, CASE WHEN lf_ok THEN f1 END AS f1, has_fin FROM v_ep e LEFT JOIN w USING (k) LEFT JOIN pc USING (k) LEFT JOIN fs USING (k)),
  res AS (SELECT episode, nosteps OR bad AS halted, CASE WHEN nosteps OR bad OR NOT stable OR v0 IN ('Multiple sufficient corrections', 'Window infeasible at ex-ante durations') THEN 'Indeterminate' ELSE v0 END AS verdict,
    CASE WHEN nosteps OR bad THEN 'missing-inputs' WHEN NOT stable THEN 'sign-unstable' WHEN v0 = 'Window infeasible at ex-ante durations' THEN 'window-infeasible' WHEN v0 = 'Multiple sufficient corrections' THEN 'multiple-sufficient' WHEN v0 = 'Indeterminate' THEN 'missing-inputs' ELSE '' END AS indeterminate_reason,
    CASE WHEN nosteps OR bad THEN '' WHEN stable THEN 'Yes' ELSE 'No' END AS sign_stable, CASE WHEN nosteps OR bad OR NOT stable THEN '' ELSE c0 END AS binding_clocks, d0, d1, b0, b1, f0, f1, has_fin FROM fv)"""
_VERDICT_CTE = "RECURSIVE " + _VERDICT_CTE.replace("RECURSIVE_MARK", f"""sc(s, mask, size, name) AS (VALUES {_SC}),
  du AS (SELECT k, ln, b, s, CASE b WHEN 0 THEN real_lo ELSE real_hi END AS r, anchor, CASE WHEN ({_BIT} & mask) <> 0 AND exp IS NOT NULL THEN least(CASE b WHEN 0 THEN real_lo ELSE real_hi END, exp) ELSE CASE b WHEN 0 THEN real_lo ELSE real_hi END END AS dur
    FROM v_real JOIN v_ep USING (k), sc, (VALUES (0), (1)) bb(b)),
  fin AS (SELECT k, ln, b, s, CAST(anchor + dur AS DOUBLE) AS f, CAST(-1e18 AS DOUBLE) AS f_prev FROM du WHERE ln = 1
    UNION ALL SELECT du.k, du.ln, du.b, du.s, CASE WHEN du.ln % 3 = 0 THEN greatest(fin.f, fin.f_prev) ELSE fin.f END + du.dur, fin.f FROM fin JOIN du ON du.k = fin.k AND du.b = fin.b AND du.s = fin.s AND du.ln = fin.ln + 1),""")


@query("verdicts", f"""WITH {_VERDICT_CTE} SELECT episode, verdict, indeterminate_reason, sign_stable, binding_clocks, CASE WHEN NOT halted THEN round(d0, 4) END AS decisive_slack_earliest, CASE WHEN NOT halted THEN round(d1, 4) END AS decisive_slack_latest,
  CASE WHEN NOT halted THEN round(b0, 4) END AS baseline_slack_earliest, CASE WHEN NOT halted THEN round(b1, 4) END AS baseline_slack_latest,
  CASE WHEN halted THEN '' WHEN least(abs(round(d0, 4)), abs(round(d1, 4))) <= 1 + 1e-9 THEN 'Yes' ELSE 'No' END AS fragile FROM res
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'Indeterminate', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM v_ol WHERE l_orderkey NOT IN (SELECT k FROM v_ep)""")
def verdicts(spark, d):
    t = N.verdicts(*network(spark, d), reactive=False)["verdicts"]
    return rounded(t.select("episode", "verdict", "indeterminate_reason", "sign_stable", "binding_clocks", "decisive_slack_earliest", "decisive_slack_latest", "baseline_slack_earliest", "baseline_slack_latest", "fragile"), 4)


@query("finance_slack", f"""WITH {_VERDICT_CTE} SELECT episode, CASE WHEN NOT halted THEN round(f0, 4) END AS finance_slack_earliest, CASE WHEN NOT halted THEN round(f1, 4) END AS finance_slack_latest,
  CASE WHEN halted THEN '' WHEN f0 IS NULL THEN CASE WHEN NOT has_fin THEN 'N/A' ELSE 'Not computable' END WHEN f0 >= -1e-9 AND f1 >= -1e-9 THEN 'Yes' WHEN f0 < -1e-9 AND f1 < -1e-9 THEN 'No' ELSE 'Unstable across bounds' END AS finance_actionable FROM res""")
def finance_slack(spark, d):
    t = N.verdicts(*network(spark, d), reactive=False)["verdicts"]
    return rounded(t.where("indeterminate_reason is not null").select("episode", "finance_slack_earliest", "finance_slack_latest", "finance_actionable"), 4)


@query("orphan_steps", f"WITH {NETWORK} SELECT CAST(l_orderkey AS VARCHAR) AS episode, count(*) AS steps FROM v_ol WHERE l_orderkey NOT IN (SELECT k FROM v_ep) GROUP BY 1")
def orphan_steps(spark, d):
    (ep, st, _, _), _ = _typed(spark, d)
    return st.join(ep, "episode", "left_anti").groupBy("episode").agg(F.count(F.lit(1)).alias("steps"))


@query("verdicts_reactive")
def verdicts_reactive(spark, d):
    return N.verdicts(*network(spark, d))["verdicts"].groupBy("verdict", "reactive_sensitivity").agg(F.count(F.lit(1)).alias("episodes"))


@query("timeline_intervals", f"""WITH {NETWORK} SELECT CAST(k AS VARCHAR) AS episode, 's' || ln AS step, clock, CAST(ready_lo - anchor AS DOUBLE) AS ready_day, CAST(f_lo - anchor AS DOUBLE) AS finish_day, CAST(f_hi - anchor AS DOUBLE) AS finish_day_latest,
  CAST(f_hi - f_lo AS DOUBLE) AS uncertainty_days FROM v_real JOIN v_ep USING (k)""")
def timeline_intervals(spark, d):
    (ep, st, _, _), _ = _typed(spark, d)
    return N.timeline_intervals(ep, st).drop("expected")


@query("zero_rule_sensitivity")
def zero_rule_sensitivity(spark, d):
    return N.zero_rule_sensitivity(*network(spark, d))["summary"]


@query("corner_check")
def corner_check(spark, d):
    (ep, st, problems, notes), labels = _typed(spark, d)
    return N.corner_check(ep, st, problems, notes, labels).groupBy("corner_check").agg(F.count(F.lit(1)).alias("episodes"))


def network_v4(spark, d):
    """The same network with ex-ante status, source class and direct record taken from the line flags."""
    ol = V.ordered_lines(spark, d)
    ep, st = network(spark, d, ol)
    flags = ol.select(F.col("l_orderkey").cast("string").alias("episode"), F.concat(F.lit("s"), "ln").alias("step"), "l_returnflag", "l_linestatus", "l_shipdate", "l_tax", "l_linenumber")
    st = st.join(flags, ["episode", "step"])
    rev = (F.col("l_returnflag") == "R") & (F.col("expected_days").isNull())
    st = st.withColumns({
        "clock": F.when(F.col("l_linenumber") == 7, "customs").otherwise(F.col("clock")), "ex_ante_status": F.when(rev, "revealed").when(F.col("l_returnflag") == "N", "S-D").otherwise(F.lit(None)),
        "revealed_at": F.when(rev & (F.col("l_tax") > 0), F.expr("timestampadd(DAY, -30, l_shipdate)")), "actionable_from": F.when(rev & (F.col("l_tax") > 0.02), F.expr("timestampadd(DAY, -40, l_shipdate)")),
        "source_class": F.when(F.col("l_linestatus") == "F", "third party").otherwise("Internal"), "direct_record": F.when(F.col("l_tax") > 0.03, "yes").when(F.col("l_tax") > 0.01, "no")})
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("episode"), F.when(F.col("o_orderpriority") == "1-URGENT", "yes").when(F.col("o_orderpriority") == "2-HIGH", "no").alias("related_party"))
    return ep.join(o, "episode", "left"), st.drop("l_returnflag", "l_linestatus", "l_shipdate", "l_tax", "l_linenumber")


@query("step_status", f"""WITH {V.ORDERED_LINES}, s AS (SELECT *, l_returnflag = 'R' AND (l_discount = 0 AND l_quantity NOT IN (1, 2)) AS rev, NOT (l_discount = 0 AND l_quantity NOT IN (1, 2)) AS has FROM v_ol),
  t AS (SELECT *, CASE WHEN rev THEN CASE WHEN l_tax > 0 THEN 'revealed' ELSE 'undocumented' END WHEN l_returnflag = 'N' THEN 'documented' WHEN has THEN 'documented' ELSE 'undocumented' END AS st FROM s)
  SELECT CAST(l_orderkey AS VARCHAR) AS episode, 's' || ln AS step, st AS status, CASE WHEN l_linestatus = 'F' THEN 'third-party' ELSE 'internal' END AS source_class, CASE WHEN l_tax > 0.03 THEN true WHEN l_tax > 0.01 THEN false END AS direct_record,
   CASE WHEN st = 'revealed' THEN CAST({_DAY.format('l_shipdate')} - 30 AS DOUBLE) END AS revealed_at FROM t""")
def step_status(spark, d):
    meta, _ = N.step_status(network_v4(spark, d)[1])
    return meta.select("episode", "step", "status", "source_class", "direct_record", "revealed_at")


@query("verdicts_v4")
def verdicts_v4(spark, d):
    return N.verdicts_v4(*network_v4(spark, d))["verdicts"].groupBy("verdict", "revelation_bounds", "claim_cap").agg(F.count(F.lit(1)).alias("episodes"))


@query("merge_institutional")
def merge_institutional(spark, d):
    return N.verdicts_v4(*network_v4(spark, d), merge_institutional=True)["verdicts"].groupBy("verdict").agg(F.count(F.lit(1)).alias("episodes"))


@query("exclude_related", f"""WITH {NETWORK} SELECT CAST(e.k AS VARCHAR) AS episode, count(s.ln) AS steps FROM v_ep e JOIN orders ON o_orderkey = e.k LEFT JOIN v_st s ON s.k = e.k WHERE o_orderpriority <> '1-URGENT' GROUP BY 1""")
def exclude_related(spark, d):
    ep, st = N.exclude_related(*network_v4(spark, d))
    return ep.select("episode").join(st.groupBy("episode").agg(F.count(F.lit(1)).alias("steps")), "episode", "left").fillna(0, ["steps"])


def _two_studies(spark, d):
    o = V.table(spark, d, "orders")
    v1 = F.when(F.col("o_orderstatus") == "F", "Non-binding").when(F.col("o_orderstatus") == "O", "Logistics-binding").otherwise("Indeterminate")
    v2 = F.when(F.col("o_orderpriority") == "1-URGENT", "Institution-binding").when(F.col("o_orderpriority") == "2-HIGH", "Indeterminate").otherwise(v1)
    a = o.where("o_totalprice > 30000").select(F.col("o_orderkey").alias("episode"), v1.alias("verdict"))
    b = o.where("o_totalprice < 450000").select(F.col("o_orderkey").alias("episode"), v2.alias("verdict"), F.when(F.col("o_orderpriority") == "1-URGENT", "institutional").otherwise("").alias("binding_clocks"),
                                               F.when(F.col("o_orderpriority") == "2-HIGH", "revelation-sensitive").otherwise("").alias("indeterminate_reason"))
    return a, b


_STUDIES = """s AS (SELECT o_orderkey AS episode, o_orderpriority AS p, CASE WHEN o_totalprice > 30000 THEN CASE o_orderstatus WHEN 'F' THEN 'Non-binding' WHEN 'O' THEN 'Logistics-binding' ELSE 'Indeterminate' END END AS v1,
  CASE WHEN o_totalprice < 450000 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'Institution-binding' WHEN o_orderpriority = '2-HIGH' THEN 'Indeterminate' ELSE CASE o_orderstatus WHEN 'F' THEN 'Non-binding' WHEN 'O' THEN 'Logistics-binding' ELSE 'Indeterminate' END END END AS v2 FROM orders)"""


@query("concordance", f"""WITH {_STUDIES} SELECT episode, v1, v2, coalesce(v1, '(absent)') <> coalesce(v2, '(absent)') AS changed, CASE WHEN coalesce(v1, '(absent)') = coalesce(v2, '(absent)') THEN '' WHEN v1 IS NULL OR v2 IS NULL THEN 'present in one study only'
  WHEN p = '2-HIGH' THEN 'revealed-in-process rule' WHEN p = '1-URGENT' THEN 'institutional clock separated from logistics' ELSE 're-coded inputs' END AS attribution FROM s WHERE v1 IS NOT NULL OR v2 IS NOT NULL""")
def concordance(spark, d):
    return N.concordance(*_two_studies(spark, d))["episodes"]


@query("concordance_crosstab", f"WITH {_STUDIES} SELECT coalesce(v1, '(absent)') AS study1, coalesce(v2, '(absent)') AS study2, count(*) AS episodes FROM s WHERE v1 IS NOT NULL OR v2 IS NOT NULL GROUP BY 1, 2")
def concordance_crosstab(spark, d):
    return N.concordance(*_two_studies(spark, d))["crosstab"]


def _layers(spark, d):
    li = V.table(spark, d, "lineitem")
    lay = F.element_at(F.array(*[F.lit(x) for x in ("Focal firm", "counterparty", "Intermediary", "institutional", "environmental", "galactic")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    st = F.element_at(F.array(*[F.lit(x) for x in ("A", "exposed", "N", "Unknown", "odd")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("episode"), lay.alias("layer"), st.alias("state"), F.when(F.col("l_discount") > 0.02, "doc").alias("evidence"))


_LAYERS = """s AS (SELECT l_orderkey AS e, ['focal-firm', 'counterparty', 'intermediary', 'institutional', 'environmental', 'galactic'][l_linenumber % 6 + 1] AS layer, ['Activated', 'Exposed', 'Not present', 'Unknown', NULL][l_suppkey % 5 + 1] AS state, l_discount > 0.02 AS ev FROM lineitem)"""


@query("layer_summary", f"""WITH {_LAYERS}, k(position, layer) AS (VALUES (0, 'focal-firm'), (1, 'counterparty'), (2, 'intermediary'), (3, 'institutional'), (4, 'environmental'))
  SELECT position, layer, count(*) FILTER (state = 'Activated') AS activated, count(*) FILTER (state = 'Exposed') AS exposed, count(*) FILTER (state = 'Not present') AS not_present, count(*) FILTER (state = 'Unknown') AS unknown FROM k LEFT JOIN s USING (layer) GROUP BY 1, 2""")
def layer_summary(spark, d):
    return N.layer_summary(_layers(spark, d))["counts"]


@query("layer_problems", f"""WITH {_LAYERS}, p AS (SELECT 'unknown layer' AS kind FROM s WHERE layer = 'galactic' UNION ALL SELECT 'unknown state' FROM s WHERE layer <> 'galactic' AND state IS NULL UNION ALL SELECT 'evidence' FROM s WHERE layer <> 'galactic' AND state = 'Activated' AND NOT ev
  UNION ALL SELECT 'twice' FROM (SELECT e, layer FROM s WHERE layer <> 'galactic' AND state IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) SELECT kind, count(*) AS n FROM p GROUP BY 1""")
def layer_problems(spark, d):
    p = F.col("problem")
    kind = F.when(p.startswith("unknown layer"), "unknown layer").when(p.startswith("unknown state"), "unknown state").when(p.startswith("Activated"), "evidence").otherwise("twice")
    return N.layer_summary(_layers(spark, d))["problems"].groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("blind_packet", """SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS codes, count(DISTINCT o_orderstatus) AS statuses FROM orders""")
def blind_packet(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("episode"), "o_orderstatus", F.lit("x").alias("verdict_note"))
    p = N.blind_packet({"orders": o}, "episode", seed=7)["orders"]
    assert p.columns == ["episode", "o_orderstatus"]
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("episode").alias("codes"), F.count_distinct("o_orderstatus").alias("statuses"))
