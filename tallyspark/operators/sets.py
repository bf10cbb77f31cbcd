"""Fuzzy-set analysis: calibration summary, necessity, truth tables, coverage of solution terms; dyads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import as_list, complete, fuzzy_calibrate, number, numeric, require
from tallyspark.operators.order_stats import quantile_at, running_counts, unpivot_numeric
from tallyspark.registry import Result, analysis
from tallyspark.runtime import small_table


@analysis("fuzzy_calibrate", "Direct calibration", "Sets")
def calibration(df: DataFrame, variable: str, full_out: float = 0.0, crossover: float = 0.5, full_in: float = 1.0) -> Result:
    """Membership column and a summary of raw and calibrated values."""
    out = df.withColumn("membership", fuzzy_calibrate(variable, full_out, crossover, full_in))
    pair = out.select(number(variable).alias("raw"), "membership").where("raw is not null")
    long = unpivot_numeric(pair, ["raw", "membership"])
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    m = long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = running_counts(long, "value", ["variable"]).groupBy("variable").agg(*[quantile_at(p).alias(k) for k, p in probs.items()])
    return Result({"membership": out, "summary": m.join(q, "variable")})


def _memberships(df: DataFrame, conditions: list[str], outcome: str) -> DataFrame:
    d = complete(numeric(df, [*conditions, outcome]), [*conditions, outcome])
    # a value outside [0, 1] stops the job when it is read; no extra pass
    inside = lambda c: F.when(F.col(c).between(0, 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must lie in [0, 1]")).cast("double"))
    return d.select(*[inside(c).alias(c) for c in conditions], inside(outcome).alias("_y"))


def necessity_table(d: DataFrame, conditions: Sequence[str]) -> DataFrame:
    entries = []
    sums = [F.sum("_y").alias("sy")]
    for i, c in enumerate(conditions):
        for tag, x in (("p", F.col(c)), ("n", 1 - F.col(c))):
            sums += [F.sum(F.least(x, F.col("_y"))).alias(f"m{tag}{i}"), F.sum(x).alias(f"x{tag}{i}")]
            entries.append((c if tag == "p" else "~" + c, f"m{tag}{i}", f"x{tag}{i}"))
    wide = d.agg(*sums)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("condition"), F.when(F.col("sy") > 0, F.col(m) / F.col("sy")).alias("consistency"), F.when(F.col(x) > 0, F.col(m) / F.col(x)).alias("coverage"))
        for n, m, x in entries])))


#: Memberships held at once while configurations are summed.
CELLS = 1 << 22


def _configuration_sums(d: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """``code, cases, x, xy, xyn``: per configuration the cases in it and the sums of memberships, with the outcome and with its negation too.

    Every row belongs to each configuration to a degree, so the sums are taken inside the partitions, on
    arrays of all configurations and as many rows as ``CELLS`` allows; no row is multiplied.
    """
    k, cols = len(conditions), [*conditions, "_y"]

    def sums(frames):
        total = np.zeros((2**k, 4))
        for f in frames:
            a = f.to_numpy(float)
            step = max(1, CELLS >> k)
            for at in range(0, len(a), step):
                x, y = a[at : at + step, :k].T, a[at : at + step, k]
                member, code = np.ones((1, x.shape[1])), np.zeros(x.shape[1], int)
                for row in x:  # the first condition is the highest digit of the code
                    member = np.stack([np.minimum(member, 1 - row), np.minimum(member, row)], 1).reshape(-1, x.shape[1])
                    code = 2 * code + (row >= 0.5)
                both = np.minimum(member, y)
                total += np.stack([np.bincount(code, minlength=2**k), member.sum(1), both.sum(1), np.minimum(both, 1 - y).sum(1)], 1)
        yield pd.DataFrame(total, columns=["cases", "x", "xy", "xyn"]).assign(code=np.arange(2**k))

    per = d.select(*cols).mapInPandas(sums, "cases double, x double, xy double, xyn double, code long")
    return per.groupBy("code").agg(F.sum("cases").cast("long").alias("cases"), *[F.sum(c).alias(c) for c in ("x", "xy", "xyn")])


def truth_table_rows(d: DataFrame, conditions: Sequence[str], frequency_cutoff: int, consistency_cutoff: float, pri_cutoff: float) -> DataFrame:
    """All 2^k configurations."""
    k = len(conditions)
    ok = (F.col("cases") >= frequency_cutoff) & (F.col("consistency") >= consistency_cutoff) & (F.col("pri") >= pri_cutoff)
    s = _configuration_sums(d, conditions).join(d.agg(F.sum("_y").alias("sy")), F.lit(True))  # one row joined to each configuration
    t = s.select(
        *[F.expr(f"cast(shiftright(code, {k - 1 - i}) & 1 as int)").alias(c) for i, c in enumerate(conditions)], "cases",
        F.when(F.col("x") > 0, F.col("xy") / F.col("x")).alias("consistency"), F.when(F.col("x") - F.col("xyn") > 0, (F.col("xy") - F.col("xyn")) / (F.col("x") - F.col("xyn"))).alias("pri"),
        F.when(F.col("sy") > 0, F.col("xy") / F.col("sy")).alias("coverage"))
    return t.withColumn("sufficient", F.coalesce(ok, F.lit(False))).orderBy(F.desc("sufficient"), F.desc_nulls_last("consistency"), F.desc("cases"))


@analysis("fsqca", "Necessity and truth table", "Sets")
def fsqca(df: DataFrame, conditions, outcome: str, frequency_cutoff: int = 1, consistency_cutoff: float = 0.8, pri_cutoff: float = 0.5) -> Result:
    cond = as_list(conditions)
    if len(cond) < 2:
        raise ValueError("name at least two conditions")
    d = _memberships(df, cond, outcome)
    return Result({"necessity": necessity_table(d, cond), "truth_table": truth_table_rows(d, cond, frequency_cutoff, consistency_cutoff, pri_cutoff)})


def _term(conditions: Mapping[str, int]) -> Column:
    parts = [F.col(c) if bit else 1 - F.col(c) for c, bit in conditions.items()]
    return F.lit(1.0) if not parts else parts[0] if len(parts) == 1 else F.least(*parts)


@analysis("term_coverage", "Coverage of solution terms", "Sets")
def term_coverage(df: DataFrame, terms: Sequence[Mapping[str, int]], outcome: str) -> Result:
    """Consistency, raw and unique coverage of given terms, and of the whole solution; a term maps condition to 1 or 0."""
    cond = list(dict.fromkeys(c for t in terms for c in t))
    d = _memberships(df, cond, outcome).select("_y", *[_term(t).alias(f"t{i}") for i, t in enumerate(terms)])
    names = [f"t{i}" for i in range(len(terms))]
    best = lambda cs: F.lit(0.0) if not cs else F.col(cs[0]) if len(cs) == 1 else F.greatest(*cs)
    sol = best(names)
    aggs = [F.sum("_y").alias("sy"), F.sum(sol).alias("sx"), F.sum(F.least(sol, F.col("_y"))).alias("sm")]
    for i, n in enumerate(names):
        gain = F.col(n) - best([m for m in names if m != n])
        aggs += [F.sum(n).alias(f"x{i}"), F.sum(F.least(n, "_y")).alias(f"m{i}"), F.sum(F.greatest(gain, F.lit(0.0))).alias(f"u{i}")]
    wide = d.agg(*aggs)
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    label = lambda t: "*".join(c if b else "~" + c for c, b in t.items()) or "1"
    rows = [F.struct(F.lit(label(t)).alias("term"), div(f"m{i}", f"x{i}").alias("consistency"), div(f"m{i}", "sy").alias("raw_coverage"),
                     (F.col(f"u{i}") / F.greatest(F.col("sy"), F.lit(1e-12))).alias("unique_coverage")) for i, t in enumerate(terms)]
    return Result({"terms": wide.select(F.inline(F.array(*rows))), "solution": wide.select(div("sm", "sx").alias("consistency"), div("sm", "sy").alias("coverage"))})


@analysis("dyad_gap", "Dyadic discrepancy", "Panel")
def dyad_gap(df: DataFrame, dyad: str, side: str, variables) -> Result:
    """Absolute gap between the two sides of every dyad with exactly two sides; correlation from three complete dyads on."""
    vs = as_list(variables)
    d = numeric(df, vs).withColumn("_side", F.col(side).cast("string"))
    require(d, [dyad])
    first = [a for i, v in enumerate(vs) for a in (
        F.min_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("_side"))).alias(f"a{i}"), F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("_side"))).alias(f"b{i}"),
        F.min(F.when(F.col(v).isNotNull(), F.col("_side"))).alias(f"sa{i}"), F.max(F.when(F.col(v).isNotNull(), F.col("_side"))).alias(f"sb{i}"))]
    wide = d.where(F.col(dyad).isNotNull()).groupBy(dyad).agg(F.min("_side").alias("lo"), F.max("_side").alias("hi"), F.count_distinct("_side").alias("sides"), *first).where("sides = 2")
    both = [F.struct(F.lit(v).alias("variable"), F.when(F.col(f"sa{i}") != F.col(f"sb{i}"), F.col(f"a{i}")).alias("a"), F.col(f"b{i}").alias("b")) for i, v in enumerate(vs)]
    long = wide.select(dyad, F.inline(F.array(*both))).where("a is not null and b is not null").withColumn("gap", F.abs(F.col("a") - F.col("b")))
    s = long.groupBy("variable").agg(F.count(F.lit(1)).alias("complete_dyads"), F.avg("gap").alias("mean_abs_gap"), F.when(F.count(F.lit(1)) > 2, F.corr("a", "b")).alias("r"))
    med = running_counts(long, "gap", ["variable"]).groupBy("variable").agg(quantile_at(0.5).alias("median_abs_gap"))
    frame = small_table(df.sparkSession, [(v,) for v in vs], "variable string")
    return Result({"gaps": frame.join(s, "variable").join(med, "variable"), "eligible": wide.agg(F.count(F.lit(1)).alias("eligible_dyads"))})
