"""Multi-arm propensity scores, overlap weights, their diagnostics and weighted contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, number, text_levels
from tallyspark.operators.glm import MlFit, fit_multinomial, solve_step
from tallyspark.operators.linear import build_design, cluster_meat, weighted_sum
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table

# Default thresholds of the estimability gates.
DEFAULT_GATES = {"min_n_per_arm": 20, "min_firms_per_arm": 12, "min_ess_per_arm": 12, "min_ess_total": 60, "max_abs_smd": 0.10, "min_ps_own_arm": 0.01}


@dataclass
class Weighted:
    """Rows with arm, propensity vector ``ps``, own-arm score and overlap weight ``w``; covariate columns ``_x1``.."""

    data: DataFrame
    levels: list[str]
    names: list[str]
    fit: MlFit

    @property
    def columns(self) -> list[str]:
        return [f"_x{i}" for i in range(1, len(self.names) + 1)]


def _scores(theta: np.ndarray, columns: Sequence[str], classes: int) -> Column:
    k = len(columns) + 1
    eta = [F.lit(0.0)] + [F.lit(float(theta[c * k])) + weighted_sum([F.col(x) for x in columns], theta[c * k + 1 : (c + 1) * k]) for c in range(classes - 1)]
    return F.array(*eta)


def propensity(df: DataFrame, treatment: str, covariates, cluster: str | None = None, outcome: str | None = None, levels: Sequence[str] | None = None) -> Weighted:
    """Unpenalised multinomial propensity model and overlap weights h / e_z with h = 1 / sum(1 / e)."""
    covs = as_list(covariates)
    kinds = dict(df.dtypes)
    numeric = [c for c in covs if kinds[c] != "string"]
    cat = [c for c in covs if kinds[c] == "string"]
    order = list(levels) if levels else text_levels(df, treatment)
    extra: dict = {"_arm": F.col(treatment).cast("string")}
    if cluster:
        extra["_g0"] = F.col(cluster)
    if outcome:
        extra["_out"] = number(outcome)
    fit, design = fit_multinomial(df, treatment, lambda code: build_design(df, code, numeric, cat, extra), order)
    eta = _scores(fit.theta, design.columns, len(order))
    d = design.data.withColumn("_eta", eta).withColumn("_e", F.transform("_eta", lambda v: F.exp(v - F.array_max("_eta"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, v: a + v)
    d = d.withColumn("_s", total).withColumn("ps", F.transform("_e", lambda v: v / F.col("_s")))
    clipped = F.transform("ps", lambda v: F.greatest(v, F.lit(1e-12)))
    d = d.withColumn("own_ps", F.element_at("ps", F.col("_y").cast("int") + 1)).withColumn("_h", 1 / F.aggregate(clipped, F.lit(0.0), lambda a, v: a + 1 / v))
    d = d.withColumn("w", F.col("_h") / F.greatest("own_ps", F.lit(1e-12))).drop("_eta", "_e", "_s", "_h")
    return Weighted(materialize(d, "weighted"), order, design.names, fit)


def ess_table(m: Weighted) -> DataFrame:
    """Size, effective sample size, least own-arm score and clusters per arm, with a total row."""
    firms = [F.count_distinct("_g0").alias("firms")] if "_g0" in m.data.columns else []
    arms = m.data.groupBy(F.col("_arm").alias("arm")).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.sum("w") * F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("ess"), F.min("own_ps").alias("min_ps_own_arm"), *firms)
    total = arms.agg(F.lit("TOTAL").alias("arm"), F.sum("n").alias("n"), F.sum("ess").alias("ess"), F.lit(None).cast("double").alias("min_ps_own_arm"))
    if firms:
        total = total.join(m.data.agg(F.count_distinct("_g0").alias("firms")), F.lit(True))
    return arms.unionByName(total)


def balance_table(m: Weighted) -> DataFrame:
    """Largest pairwise standardised mean difference per covariate, raw and weighted; scale is the rms of the arm SDs."""
    entries = F.array(*[F.struct(F.lit(n).alias("covariate"), F.col(c).alias("x")) for n, c in zip(m.names, m.columns)])
    long = m.data.select("_arm", "w", F.inline(entries))
    per = long.groupBy("covariate", "_arm").agg(F.avg("x").alias("raw"), F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("weighted"), F.var_samp("x").alias("v"))
    sd = F.sqrt(F.avg("v"))
    gap = lambda c: F.when(sd > 0, (F.max(c) - F.min(c)) / sd).otherwise(0.0)
    return per.groupBy("covariate").agg(gap("raw").alias("max_smd_unweighted"), gap("weighted").alias("max_smd_weighted"))


def estimability_gates(ess: DataFrame, balance: DataFrame, thresholds: Mapping[str, float] | None = None, arms: Sequence[str] | None = None) -> DataFrame:
    """Outcome-blind gates: one row per comparison with its value and whether it passes."""
    g = {**DEFAULT_GATES, **(thresholds or {})}
    e = ess.where("arm <> 'TOTAL'")
    if arms:
        e = e.where(F.col("arm").isin(*[str(a) for a in arms]))
    tests = [("n", "n", "min_n_per_arm"), ("ess", "ess", "min_ess_per_arm"), ("min_ps_own_arm", "min_ps_own_arm", "min_ps_own_arm")]
    if "firms" in ess.columns:
        tests.append(("firms", "firms", "min_firms_per_arm"))
    per = e.select(F.inline(F.array(*[F.struct(F.concat(F.lit(name), F.lit("["), "arm", F.lit("]")).alias("gate"), F.col(c).cast("double").alias("value"), (F.col(c) >= g[t]).alias("pass")) for name, c, t in tests])))
    total = e.agg(F.sum("ess").alias("value")).select(F.lit("ess[total of arms used]").alias("gate"), "value", (F.col("value") >= g["min_ess_total"]).alias("pass"))
    smd = balance.agg(F.coalesce(F.max(F.abs("max_smd_weighted")), F.lit(0.0)).alias("value")).select(F.lit("max weighted smd").alias("gate"), "value", (F.col("value") <= g["max_abs_smd"]).alias("pass"))
    return per.unionByName(total).unionByName(smd)


def parse_contrast(spec: str, levels: Sequence[str]) -> np.ndarray:
    """'A-B' or 'A:0.5,B:0.5,C:-1'; the coefficients must sum to zero."""
    parts = [p.rsplit(":", 1) for p in spec.split(",")] if ":" in spec else [[s, v] for s, v in zip(spec.split("-", 1), ("1", "-1"))]
    c = np.zeros(len(levels))
    for name, v in parts:
        if name.strip() not in levels:
            raise ValueError(f"unknown arm {name.strip()!r}")
        c[list(levels).index(name.strip())] += float(v)
    if abs(c.sum()) > 1e-9:
        raise ValueError("contrast coefficients must sum to 0")
    return c


@analysis("overlap_contrast", "Overlap-weighted contrast", "Causal")
def overlap_contrast(df: DataFrame, treatment: str, covariates, cluster: str, outcome: str, contrast: str, gates: Mapping | None = None, force: bool = False, levels: Sequence[str] | None = None) -> Result:
    """Weighted arm means and a linear contrast with CR2 errors; refused when a gate fails, unless forced."""
    m = propensity(df, treatment, covariates, cluster, outcome, levels)
    c = parse_contrast(contrast, m.levels)
    ess, bal = ess_table(m), balance_table(m)
    gt = estimability_gates(ess, bal, gates)
    failed = [r["gate"] for r in gt.where(~F.col("pass")).collect()]
    if failed and not force:
        raise ValueError(f"estimability gates failed: {failed}; pass force=True for an exploratory estimate")
    d = m.data.where("w > 0")
    sums = {r["_arm"]: (r["sw"], r["mean"]) for r in d.groupBy("_arm").agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("_out")) / F.sum("w")).alias("mean")).collect()}
    mu = np.array([sums[a][1] for a in m.levels])
    bread = np.diag([1.0 / sums[a][0] for a in m.levels])
    z = [F.when(F.col("_arm") == a, 1.0).otherwise(0.0) for a in m.levels]
    fitted = F.lit(0.0)
    for a, v in zip(m.levels, mu):
        fitted = F.when(F.col("_arm") == a, F.lit(float(v))).otherwise(fitted)
    meat, g = cluster_meat(d, z, F.col("_out") - fitted, F.col("w"), "_g0", bread, "CR2")
    v = bread @ meat @ bread
    est, se, dof = float(c @ mu), float(np.sqrt(c @ v @ c)), max(g - 1, 1)
    t = est / se
    crit = float(dist.t_ppf(0.975, np.array([float(dof)]))[0])
    spark = df.sparkSession
    return Result({
        "means": small_table(spark, [(a, float(mu[i]), float(np.sqrt(v[i, i]))) for i, a in enumerate(m.levels)], "arm string, weighted_mean double, se double"),
        "contrast": small_table(spark, [(contrast, est, se, t, dof, float(dist.t_two_sided([t], [float(dof)])[0]), est - crit * se, est + crit * se, g)],
                                "contrast string, estimate double, se double, t double, df int, p double, ci_low double, ci_high double, clusters long"),
        "gates": gt, "ess": ess, "balance": bal}, warnings=[f"gate failed: {f}" for f in failed])


#: Rows of a block of the bootstrap: a block holds a few matrices of rows times replicates.
BOOT_ROWS = 512


def _replicate_sums(rows: DataFrame, columns: Sequence[str], replicates: int, size: int, kernel) -> np.ndarray:  # noqa: ANN001
    """``size`` sums a replicate over rows that carry the list of the replicates their cluster is drawn for (``drawn``).

    ``kernel(m, a)`` gets a block's multiplicities (rows by replicates) and its ``columns`` and returns replicates by
    ``size``. A task gives one row a replicate, and these are added up by replicate; only the sums come to the driver.
    """

    def job(batches):  # noqa: ANN001, ANN202
        acc = np.zeros((replicates, size))
        for pdf in batches:
            pos, drawn = pdf["pos"].to_numpy(), pdf["drawn"].to_numpy()
            for k in range(0, len(pdf), BOOT_ROWS):
                _, first, which = np.unique(pos[k : k + BOOT_ROWS], return_index=True, return_inverse=True)
                m = np.stack([np.bincount(drawn[k + f], minlength=replicates) for f in first]).astype(float)[which]
                acc += kernel(m, pdf[list(columns)].iloc[k : k + BOOT_ROWS].to_numpy(float))
        yield pd.DataFrame({"rep": np.arange(replicates), "v": list(acc)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rep": pdf["rep"][:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    parts = rows.select("pos", "drawn", *columns).mapInPandas(job, "rep int, v array<double>")
    out = np.zeros((replicates, size))
    for r in parts.groupBy("rep").applyInPandas(add, "rep int, v array<double>").collect():
        out[r["rep"]] = r["v"]
    return out


def _propensities(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Chances of every arm, rows by replicates by arms, for coefficients replicates by (arms - 1) by columns."""
    eta = np.concatenate([np.zeros((len(x), len(theta), 1)), np.tensordot(x, theta, axes=(1, 2))], axis=2)
    e = np.exp(eta - eta.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


@analysis("cluster_bootstrap", "Cluster bootstrap", "Causal")
def cluster_bootstrap(df: DataFrame, treatment: str, covariates, cluster: str, outcome: str, contrast: str, replicates: int = 999, seed: int = 1, max_iter: int = 25) -> Result:
    """Clusters resampled with replacement, the propensity model refitted in every replicate, failures counted by kind.

    Every replicate draws as many clusters as there are; the draws are a Spark range, gathered by cluster: about as
    many numbers as there are replicates. No rows are copied: a row counts in each replicate as often as its cluster
    is drawn, and one pass over the rows gives the Newton steps of all replicates as products of matrices, so
    the number of passes is that of the iterations, whatever the number of replicates.
    """
    covs = as_list(covariates)
    levels = text_levels(df, treatment)
    c = parse_contrast(contrast, levels)
    code = F.lit(None).cast("double")
    for i, a in enumerate(levels):
        code = F.when(F.col(treatment).cast("string") == a, F.lit(float(i))).otherwise(code)
    design = build_design(df, code, covs, extra={"_g0": F.col(cluster), "_out": number(outcome)})
    data = materialize(design.data, "boot_rows")
    from tallyspark.operators.order_stats import running_counts

    ids = materialize(running_counts(data.select("_g0").distinct(), "_g0").select(F.col("value").alias("_g0"), F.col("before").alias("pos")), "boot_ids")
    g = ids.count()
    draws = df.sparkSession.range(replicates * g).select((F.col("id") / g).cast("int").alias("rep"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(g)).alias("pos"))
    drawn = materialize(draws.groupBy("pos").agg(F.collect_list("rep").alias("drawn")).join(ids, "pos"), "boot_draws")
    rows = data.select("_g0", "_out", "_y", *design.columns).join(drawn, "_g0")
    classes = len(levels)
    arm = np.arange(classes)
    held = _replicate_sums(rows, ["_y"], replicates, classes, lambda m, a: m.T @ (a[:, :1] == arm).astype(float))
    missing = set(np.flatnonzero((held == 0).any(axis=1)).tolist())
    k = len(design.names) + 1
    p = (classes - 1) * k
    theta = np.zeros((replicates, classes - 1, k))
    active, converged = np.array([b for b in range(replicates) if b not in missing], int), []
    for _ in range(max_iter):
        if not len(active):
            break
        now, open_ = theta[active], active

        def step_sums(m: np.ndarray, a: np.ndarray, now: np.ndarray = now, open_: np.ndarray = open_) -> np.ndarray:
            z, x = a[:, 0].astype(int), np.concatenate([np.ones((len(a), 1)), a[:, 1:]], axis=1)
            ps, w = _propensities(x, now), m[:, open_]
            out = np.zeros((replicates, 1 + p + p * p))
            out[open_, 0] = (w * np.log(np.maximum(ps[np.arange(len(a)), :, z], 1e-300))).sum(axis=0)
            grad = [(w * ((z == q)[:, None] - ps[:, :, q])).T @ x for q in range(1, classes)]
            out[open_, 1 : 1 + p] = np.concatenate(grad, axis=1)
            xx = (x[:, :, None] * x[:, None, :]).reshape(len(a), k * k)
            hess = np.empty((len(open_), classes - 1, k, classes - 1, k))
            for q in range(1, classes):
                for r in range(1, classes):
                    hess[:, q - 1, :, r - 1, :] = -((w * ps[:, :, q] * ((q == r) - ps[:, :, r])).T @ xx).reshape(-1, k, k)
            out[open_, 1 + p :] = hess.reshape(len(open_), p * p)
            return out

        sums = _replicate_sums(rows, ["_y", *design.columns], replicates, 1 + p + p * p, step_sums)
        still = []
        for b in active:
            gr, h = sums[b, 1 : 1 + p], sums[b, 1 + p :].reshape(p, p)
            step = solve_step(h, gr)
            if not np.all(np.isfinite(step)):
                continue
            if float(gr @ step) < 1e-10 * max(1.0, abs(sums[b, 0])):
                converged.append(int(b))
                continue
            # damp a step that would move a linear predictor by more than a few units at once
            theta[b] += (step * min(1.0, 5.0 / max(np.abs(step[::k]).max(), 1e-12))).reshape(classes - 1, k)
            still.append(b)
        active = np.array(still, int)
    good = np.array(sorted(converged), int)
    fitted = theta[good]

    def arm_sums(m: np.ndarray, a: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(a), 1)), a[:, 2:]], axis=1)
        z, ps = a[:, 1].astype(int), np.clip(_propensities(x, fitted), 1e-12, 1)
        w = m[:, good] / (1 / ps).sum(axis=2) / ps[np.arange(len(a)), :, z]
        out = np.zeros((replicates, 2 * classes))
        own = (z[:, None] == arm).astype(float)
        out[good, :classes], out[good, classes:] = w.T @ own, w.T @ (own * a[:, :1])
        return out

    sums = _replicate_sums(rows, ["_out", "_y", *design.columns], replicates, 2 * classes, arm_sums)[good] if len(good) else np.zeros((0, 2 * classes))
    means = sums[:, classes:] / np.where(sums[:, :classes] == 0, np.nan, sums[:, :classes])
    used = np.asarray(c, float) != 0
    est = small_table(df.sparkSession, [(int(b), float(v)) for b, v in zip(good, means[:, used] @ np.asarray(c, float)[used])], "rep int, estimate double")
    from tallyspark.operators.order_stats import quantile_at

    rc = running_counts(est, "estimate")
    ci = rc.agg(quantile_at(0.025).alias("ci_low"), quantile_at(0.975).alias("ci_high"))
    s = est.agg(F.lit(replicates).alias("requested"), F.count("estimate").alias("successful"), F.stddev_samp("estimate").alias("boot_se"))
    s = s.join(ci, F.lit(True)).withColumns({"arm_missing": F.lit(len(missing)), "not_converged": F.lit(replicates - len(missing) - len(good))})
    return Result({"summary": s, "estimates": est})
