"""Evidence-graded intervals, bounds of an expression over a parameter box, breakdown values, latency bounds."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import interval_high, interval_low
from tallyspark.operators.boxes import Expression
from tallyspark.operators.hypothesis import wilson_interval
from tallyspark.operators.order_stats import running_counts
from tallyspark.registry import Result, analysis

# Order in which evidence grades are admitted, and route states that cannot be used.
LADDER = ("A", "B", "C", "D", "E", "S", "I")
NOT_USABLE = ("refused", "withdrawn", "abandoned", "conditions_unmet")


def admit_intervals(evidence: DataFrame, keys: Sequence[str], ladder: Sequence[str] = LADDER) -> DataFrame:
    """Running intersection of the intervals of every key in ladder order, one row per key and rung.

    ``evidence`` has the keys, ``grade``, ``low``, ``high``. A non-overlapping interval is a conflict
    and is not admitted. Several rows of one grade are first joined into their hull, so what is folded
    per key is never longer than the ladder.
    """
    wide = _rungs(evidence, keys, ladder)
    rung = lambda i, g: F.struct(F.lit(g).alias("rung"), *[F.col(f"_{c}{i}").alias(c) for c in ("low", "high", "conflict", "given_low", "given_high")])
    return wide.select(*keys, F.inline(F.array(*[rung(i, g) for i, g in enumerate(ladder)])))


def _rungs(evidence: DataFrame, keys: Sequence[str], ladder: Sequence[str]) -> DataFrame:
    """One row per key with the columns ``_low0, _high0, _conflict0, _given_low0, _given_high0`` of the first rung, and so on.

    The ladder is short and known, so every rung is a few plain columns made from those of the rung before.
    """
    lo, hi = F.least("low", "high"), F.greatest("low", "high")
    given = [c for i, g in enumerate(ladder) for c in (F.min(F.when(F.col("grade") == g, lo)).alias(f"_given_low{i}"), F.max(F.when(F.col("grade") == g, hi)).alias(f"_given_high{i}"))]
    wide = evidence.where(F.col("grade").isin(*ladder)).groupBy(*keys).agg(*given)
    none = F.lit(None).cast("double")
    clo, chi = none, none
    for i in range(len(ladder)):
        new_lo, new_hi = F.col(f"_given_low{i}"), F.col(f"_given_high{i}")
        nlo, nhi = F.greatest(clo, new_lo), F.least(chi, new_hi)
        first, idle = clo.isNull(), new_lo.isNull()
        wide = wide.withColumn(f"_conflict{i}", F.coalesce(~first & ~idle & (nlo > nhi), F.lit(False)))
        pick = lambda cur, fresh, both: F.when(idle | F.col(f"_conflict{i}"), cur).when(first, fresh).otherwise(both)  # noqa: B023, E731
        wide = wide.withColumns({f"_low{i}": pick(clo, new_lo, nlo), f"_high{i}": pick(chi, new_hi, nhi)})
        clo, chi = F.col(f"_low{i}"), F.col(f"_high{i}")
    return wide


def admission_conflicts(rungs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rungs.where("conflict").select(*keys, F.col("rung").alias("grade"), F.col("low").alias("kept_low"), F.col("high").alias("kept_high"),
                                          F.col("given_low").alias("rejected_low"), F.col("given_high").alias("rejected_high"))


def survey_interval(df: DataFrame, value: str, by: Sequence[str] = (), method: str = "ci95") -> DataFrame:
    """Interval from raw answers: normal interval of the mean, or nearest-rank 10th to 90th percentile."""
    by = list(by)
    if method == "ci95":
        half = 1.959964 * F.stddev_samp(value) / F.sqrt(F.count(value))
        ok = F.count(value) >= 2
        return df.groupBy(*by).agg(F.count(value).alias("n"), F.when(ok, F.avg(value) - half).alias("low"), F.when(ok, F.avg(value) + half).alias("high"))
    if method != "p10p90":
        raise ValueError(f"unknown method {method!r}")
    at = lambda p: F.floor(F.lit(p) * (F.col("total") - 1) + 0.5)
    hit = lambda p: F.max(F.when((F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("n")), F.col("value")))
    rc = running_counts(df, value, by)
    return rc.groupBy(*by).agg(F.max("total").alias("n"), hit(0.1).alias("low"), hit(0.9).alias("high")).where("n >= 2")


_FUNCTIONS = {"min": "least", "max": "greatest", "least": "least", "greatest": "greatest", "abs": "abs", "log": "ln", "exp": "exp", "sqrt": "sqrt", "power": "power"}


def formula(expression: str, names: Mapping[str, str] | Sequence[str]) -> str:
    """A user's arithmetic expression as SQL; only the given names and a few functions may occur.

    ``names`` are columns, or SQL to put in the place of each name.
    """
    if not re.fullmatch(r"[\w\s+\-*/().,]+", expression):
        raise ValueError("only names, numbers, + - * / ( ) and , may be used")
    put = dict(names) if isinstance(names, Mapping) else {n: f"`{n}`" for n in names}

    def swap(m: re.Match) -> str:
        word, call = m.group(1), m.group(2)
        if call:
            if word not in _FUNCTIONS:
                raise ValueError(f"function {word!r} is not allowed")
            return _FUNCTIONS[word] + call
        if word not in put:
            raise ValueError(f"no value or evidence for {word!r}")
        return put[word]

    return re.sub(r"\b([A-Za-z_]\w*)\b(\s*\()?", swap, expression)


def _corner(params: Sequence[str]) -> dict[str, str]:
    """SQL for each parameter at corner number ``c`` of its row's box: bit i picks the end of parameter i."""
    return {p: f"(CASE WHEN shiftright(c, {i}) & 1 = 1 THEN `hi_{p}` ELSE `lo_{p}` END)" for i, p in enumerate(params)}


def parameter_boxes(evidence: DataFrame, case: Sequence[str], parameter: str, params: Sequence[str], ladder: Sequence[str] = LADDER) -> DataFrame:
    """One row per case and rung with the admitted interval of every parameter and the number still missing."""
    case = list(case)
    rungs = admit_intervals(evidence, [*case, parameter], ladder)
    wide = rungs.groupBy(*case, "rung").agg(
        *[F.max(F.when(F.col(parameter) == p, F.col(c))).alias(f"{t}_{p}") for p in params for t, c in (("lo", "low"), ("hi", "high"))])
    missing = sum((F.col(f"lo_{p}").isNull().cast("int") for p in params), F.lit(0))
    return wide.withColumn("missing", missing)


def _extremes(expression: Expression):  # noqa: ANN202
    """A function of two array columns, the ends of the intervals: the struct (low, high) of the expression."""

    @F.pandas_udf("low double, high double")
    def extremes(low: pd.Series, high: pd.Series) -> pd.DataFrame:
        # rows with a parameter missing come along and get nothing
        a, b = (np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(expression.params)) for x in (low, high))
        known = ~(np.isnan(a) | np.isnan(b)).any(axis=1)
        out = np.full((2, len(a)), np.nan)
        out[:, known] = expression.extremes(np.minimum(a, b)[known], np.maximum(a, b)[known])
        return pd.DataFrame({k: pd.Series(v, dtype=object).where(~np.isnan(v), None) for k, v in zip(("low", "high"), out)})

    return extremes


@analysis("bounds", "Evidence-graded bounds", "Evidence")
def bounds(evidence: DataFrame, case, expression: str, params: Sequence[str], parameter: str = "parameter", fixed: Mapping[str, float] | None = None,
           threshold: float = 0.0, label_below: str = "below threshold favoured", label_above: str = "above threshold favoured",
           ladder: Sequence[str] = LADDER, breakdown_parameter: str | None = None, breakdown_side: str = "high") -> Result:
    """Lowest and highest value of an expression over the corners of the admitted box, per case and rung.

    Ranges of the derivatives say at which end of its interval a parameter stands; only where a sign stays open both ends
    are tried, so rows with dozens of uncertain parameters are no larger than others. Corners at which the expression
    has no finite value are passed over; a row without any other gets null.
    """
    case = [case] if isinstance(case, str) else list(case)
    fixed = dict(fixed or {})
    given = {k: f"CAST({float(v)!r} AS DOUBLE)" for k, v in fixed.items()}
    boxes = parameter_boxes(evidence, case, parameter, params, ladder)
    ends = [F.array(*[F.col(f"{t}_{p}").cast("double") for p in params]) for t in ("lo", "hi")]
    table = boxes.withColumn("_v", F.when(F.col("missing") == 0, _extremes(Expression(expression, list(params), fixed))(*ends))).select(*case, "rung", "missing", "_v.low", "_v.high")
    label = F.when(F.col("high") < threshold, label_below).when(F.col("low") > threshold, label_above).otherwise("assumption-sensitive")
    table = table.withColumn("status", F.when(F.col("missing") > 0, "NOT IDENTIFIED").otherwise(label))
    out = {"rungs": table, "conflicts": admission_conflicts(admit_intervals(evidence, [*case, parameter], ladder), [*case, parameter])}
    if breakdown_parameter:
        known = boxes.where(F.col("missing") == 0).where(F.col("rung") == ladder[-1])
        out["breakdown"] = breakdown_value(known, case, expression, params, given, breakdown_parameter, threshold, breakdown_side)
    return Result(out)


def breakdown_value(boxes: DataFrame, case: Sequence[str], expression: str, params: Sequence[str], given: Mapping[str, str], parameter: str, threshold: float, side: str) -> DataFrame:
    """Value of one parameter at which the worst bound meets the threshold; ``boxes`` has a row for each case.

    For a parameter that enters affinely every corner of the others gives a line, so the worst
    bound is an envelope of lines and its roots are extremes of the lines' roots. A parameter that
    does not enter affinely gives null. Two crossings are possible; the one nearest the admitted
    range is returned, and their number. The lines are an array in the row of their case.
    """
    case, others = list(case), [p for p in params if p != parameter]
    sign = 1.0 if side == "high" else -1.0
    at = lambda x: f"{sign!r}D * ({formula(expression, {**_corner(others), **given, parameter: f'{x!r}D'})} - CAST({float(threshold)!r} AS DOUBLE))"
    lines = F.expr(f"transform(sequence(0L, {2 ** len(others) - 1}L), c -> named_struct('a', CAST({at(0.0)} AS DOUBLE), 'v1', CAST({at(1.0)} AS DOUBLE), 'v3', CAST({at(3.0)} AS DOUBLE)))")
    d = boxes.select(*case, F.col(f"lo_{parameter}").alias("lo"), F.col(f"hi_{parameter}").alias("hi"), lines.alias("l"))
    slope = lambda x: x["v1"] - x["a"]
    flat = lambda x: F.abs(slope(x)) < 1e-12
    straight = lambda x: F.coalesce(F.abs(x["v3"] - x["a"] - 3 * slope(x)) <= 1e-9 * (1 + F.abs(x["v3"]) + F.abs(x["a"])), F.lit(False))
    roots = lambda keep: F.transform(F.filter("l", keep), lambda x: -x["a"] / slope(x))
    env = d.select(*case, "lo", "hi", F.forall("l", straight).alias("affine"), F.exists("l", lambda x: flat(x) & (x["a"] > 0)).alias("blocked"),
                   F.array_max(roots(lambda x: ~flat(x) & (slope(x) < 0))).alias("left"), F.array_min(roots(lambda x: ~flat(x) & (slope(x) > 0))).alias("right"))
    ok = F.col("affine") & ~F.col("blocked") & (F.coalesce("left", F.lit(float("-inf"))) <= F.coalesce("right", F.lit(float("inf"))))
    away = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col("lo") - F.col(c), F.col(c) - F.col("hi"), F.lit(0.0)))
    left_first = F.col("right").isNull() | (away("left") < away("right"))
    val = F.when(ok, F.when(F.col("left").isNotNull() & left_first, F.col("left")).otherwise(F.col("right")))
    n = F.when(ok, F.col("left").isNotNull().cast("int") + F.col("right").isNotNull().cast("int")).otherwise(0)
    return env.select(*case, F.lit(parameter).alias("parameter"), val.alias("value"), n.alias("crossings"), F.col("lo").alias("admitted_low"), F.col("hi").alias("admitted_high"),
                      val.between(F.col("lo"), F.col("hi")).alias("inside_admitted_range"))


@analysis("latency_bounds", "Latency bounds", "Evidence")
def latency_bounds(routes: DataFrame, stages: DataFrame | None = None, totals: DataFrame | None = None, ladder: Sequence[str] = LADDER, cap: float = 365.0) -> Result:
    """Bounds on each route's total time, its deadline label and margin, and bounds on the share usable in time.

    ``routes``: route, status, window_low, window_high, elapsed. ``stages``: route, stage, grade, low, high.
    ``totals``: route, grade, low, high. A stage listed without an interval (null low) leaves the route's sum open.
    """
    r = routes
    top = len(ladder) - 1
    conflicts = []
    if stages is not None:
        rungs = admit_intervals(stages, ["route", "stage"], ladder)
        last = _rungs(stages, ["route", "stage"], ladder).select("route", F.col(f"_low{top}").alias("low"), F.col(f"_high{top}").alias("high"))
        per = last.groupBy("route").agg(F.bool_and(F.col("low").isNotNull()).alias("complete"), F.sum("low").alias("sum_low"), F.sum("high").alias("sum_high"))
        r = r.join(per, "route", "left").withColumns({
            "l0": F.when(F.col("complete"), F.col("sum_low")), "h0": F.when(F.col("complete"), F.col("sum_high"))}).drop("complete", "sum_low", "sum_high")
        conflicts.append(rungs.where("conflict").select("route", F.concat(F.lit("stage "), "stage").alias("where"), F.col("rung").alias("grade")))
    else:
        r = r.withColumns({"l0": F.lit(None).cast("double"), "h0": F.lit(None).cast("double")})
    if totals is not None:
        rungs = admit_intervals(totals, ["route"], ladder)
        r = r.join(_rungs(totals, ["route"], ladder).select("route", F.col(f"_low{top}").alias("tl"), F.col(f"_high{top}").alias("th")), "route", "left")
        conflicts.append(rungs.where("conflict").select("route", F.lit("total").alias("where"), F.col("rung").alias("grade")))
    else:
        r = r.withColumns({"tl": F.lit(None).cast("double"), "th": F.lit(None).cast("double")})
    lo, hi = F.greatest("l0", "tl"), F.least("h0", "th")
    both = F.col("l0").isNotNull() & F.col("tl").isNotNull()
    r = r.withColumn("total_clash", F.coalesce(both & (lo > hi), F.lit(False)))
    r = r.withColumns({"l1": F.when(F.col("total_clash"), F.col("l0")).otherwise(lo), "h1": F.when(F.col("total_clash"), F.col("h0")).otherwise(hi)})
    pending = (F.col("status") == "pending") & F.col("elapsed").isNotNull()
    clash = F.coalesce(pending & (F.col("h1") < F.col("elapsed")), F.lit(False))
    reset = pending & (F.col("l1").isNull() | clash)
    r = r.withColumns({
        "censor_clash": clash,
        "low": F.when(reset, F.col("elapsed")).when(pending, F.greatest("l1", "elapsed")).otherwise(F.col("l1")),
        "high": F.when(reset, F.lit(float(cap))).otherwise(F.col("h1"))})
    w_lo, w_hi = interval_low(F.col("window_low"), F.coalesce("window_high", "window_low")), interval_high(F.col("window_low"), F.coalesce("window_high", "window_low"))
    label = (F.when(F.col("status").isin(*NOT_USABLE), "not usable").when(F.col("low").isNull() | F.col("window_low").isNull(), "not identified")
             .when(F.col("high") <= w_lo, "surely on time").when(F.col("low") > w_hi, "surely late").otherwise("undetermined"))
    table = r.select("route", "status", "low", "high", label.alias("label"), (w_lo - F.col("high")).alias("margin_low"), (w_hi - F.col("low")).alias("margin_high"),
                     F.col("status").isin("screened_out", "not_attempted").alias("ex_ante"), "total_clash", "censor_clash")
    conflicts += [r.where("total_clash").select("route", F.lit("total").alias("where"), F.lit("total").alias("grade")),
                  r.where("censor_clash").select("route", F.lit("censoring").alias("where"), F.lit("elapsed").alias("grade"))]
    listed = conflicts[0]
    for c in conflicts[1:]:
        listed = listed.unionByName(c)
    return Result({"routes": table, "counts": table.groupBy("label").agg(F.count(F.lit(1)).alias("routes")), "share": manski_share(table), "conflicts": listed})


def manski_share(table: DataFrame) -> DataFrame:
    """Worst-case bounds on the share usable in time, each end with a Wilson interval for sampling."""
    s = table.agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(F.col("label") == "surely on time").alias("k_low"),
        F.count_if(F.col("label").isin("surely on time", "undetermined", "not identified")).alias("k_high"))
    a, b = wilson_interval(F.col("k_low"), F.col("routes"))
    c, d = wilson_interval(F.col("k_high"), F.col("routes"))
    return s.select("routes", F.try_divide("k_low", "routes").alias("lower"), F.try_divide("k_high", "routes").alias("upper"),
                    a.alias("lower_wilson_low"), b.alias("lower_wilson_high"), c.alias("upper_wilson_low"), d.alias("upper_wilson_high"))
