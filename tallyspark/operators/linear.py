"""Least squares with classical, HC3 and cluster-robust errors, from sums of products.

One pass over the table yields the centred cross-product matrix of the model columns
(k x k numbers); the solve happens on that matrix. Robust errors need one more pass, and
cluster errors one grouped pass whose rows are the clusters' sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, dummy_columns, first_difference, number, require, text_levels
from tallyspark.operators.describe import association_aggregates, contingency, frequencies, full_grid
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table


@dataclass
class Design:
    """Complete rows with the outcome in ``_y``, regressors in ``_x1``.. (the intercept is implicit), extras kept."""

    data: DataFrame
    names: list[str]

    @property
    def columns(self) -> list[str]:
        return [f"_x{i}" for i in range(1, len(self.names) + 1)]


def build_design(
    df: DataFrame, y: Column | str | None, x: Sequence[str] = (), categorical: Sequence[str] = (), extra: Mapping[str, Column | str] | None = None,
    baselines: Mapping[str, str] | None = None, terms: Mapping[str, Column] | None = None,
) -> Design:
    """Model columns after listwise deletion; categorical predictors become 0/1 columns against their first text level."""
    x, categorical = list(x), list(categorical)
    require(df, [*x, *categorical])
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    needed = {f"_n{i}": number(c) for i, c in enumerate(x)} | {f"_c{i}": F.col(c).cast("string") for i, c in enumerate(categorical)}
    needed |= {f"_t{i}": c for i, c in enumerate((terms or {}).values())}
    needed |= {k: as_col(c) for k, c in (extra or {}).items()}
    if y is not None:
        needed["_y"] = as_col(y)
    kept = df.select(*[c.alias(k) for k, c in needed.items()]).dropna()
    cols = {n: F.col(f"_n{i}") for i, n in enumerate(x)}
    for i, c in enumerate(categorical):
        coded = dummy_columns(f"_c{i}", text_levels(kept, f"_c{i}"), (baselines or {}).get(c))
        cols |= {f"{c}={k.split('=', 1)[1]}": e for k, e in coded.items()}
    cols |= {n: F.col(f"_t{i}") for i, n in enumerate(terms or {})}
    keep = [k for k in needed if not k.startswith(("_n", "_c", "_t"))]
    data = kept.select(*keep, *[e.alias(f"_x{i}") for i, e in enumerate(cols.values(), 1)])
    return Design(data, list(cols))


@dataclass
class LinearFit:
    names: list[str]
    n: int
    coef: np.ndarray
    bread: np.ndarray  # inverse of the centred cross-product matrix, intercept first
    means: np.ndarray
    to_raw: np.ndarray  # maps centred coefficients to the original ones
    rss: float
    tss: float
    weight_sum: float
    s_xx: np.ndarray
    vcov: np.ndarray = field(default=None)
    kind: str = "classical"
    df: int = 0
    clusters: int | None = None

    @property
    def k(self) -> int:
        return len(self.names)

    def contrast(self, c: Sequence[float]) -> dict:
        c = np.asarray(c, float)
        est, se = float(c @ self.coef), float(np.sqrt(max(c @ self.vcov @ c, 0.0)))
        t = est / se if se > 0 else None
        crit = float(dist.t_ppf(0.975, np.array([float(self.df)]))[0])
        p = float(dist.t_two_sided(np.array([t]), np.array([float(self.df)]))[0]) if t is not None else None
        return {"estimate": est, "se": se, "t": t, "df": self.df, "p": p, "ci_low": est - crit * se, "ci_high": est + crit * se}


def weighted_sum(cols: Sequence[Column], coefs: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, b in zip(cols, coefs):
        total = total + c * F.lit(float(b))
    return total


def _centred_products(d: DataFrame, cols: list[str], weight: Column | None) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Row count, weight total, (weighted) means and centred sums of products of the columns."""
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    if weight is None:
        r = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.covar_pop(cols[i], cols[j]).alias(f"s{i}_{j}") for i, j in upper]).first()
        n, sw = r["n"], float(r["n"])
        means = np.array([r[f"m{i}"] for i in range(k)], float)
        scale = sw
    else:
        r = d.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("sw"), *[F.sum(weight * F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        n, sw = r["n"], float(r["sw"] or 0.0)
        means = np.array([r[f"m{i}"] for i in range(k)], float) / sw
        centred = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, means)]
        r = d.agg(*[F.sum(weight * centred[i] * centred[j]).alias(f"s{i}_{j}") for i, j in upper]).first()
        scale = 1.0
    s = np.zeros((k, k))
    for i, j in upper:
        s[i, j] = s[j, i] = float(r[f"s{i}_{j}"] or 0.0) * scale
    return n, sw, means, s


def fit_linear(design: Design, weight: str | None = None) -> LinearFit:
    """Least squares from one pass (two with weights) over the design."""
    d = design.data.where(F.col(weight) > 0) if weight else design.data
    n, sw, means, s = _centred_products(d, [*design.columns, "_y"], F.col(weight) if weight else None)
    return _solve(design.names, n, sw, means, s, weight is None)


def _solve(names, n, sw, means, s, unweighted=True) -> LinearFit:
    k = len(names)
    sxx, sxy, syy = s[:k, :k], s[:k, k], s[k, k]
    inv = np.linalg.pinv(sxx) if k else np.zeros((0, 0))
    b = inv @ sxy
    bread = np.zeros((k + 1, k + 1))
    bread[0, 0], bread[1:, 1:] = 1.0 / sw, inv
    to_raw = np.eye(k + 1)
    to_raw[0, 1:] = -means[:k]
    coef = np.concatenate([[means[k] - means[:k] @ b], b])
    rss = max(float(syy - b @ sxy), 0.0)
    fit = LinearFit(["(Intercept)", *names], n, coef, bread, means, to_raw, rss, float(syy), sw, sxx, df=n - k - 1)
    fit.vcov = to_raw @ bread @ to_raw.T * (rss / fit.df if fit.df > 0 else np.nan)
    return fit


def _centred_design(design: Design, fit: LinearFit) -> tuple[list[Column], Column]:
    z = [F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip(design.columns, fit.means)]]
    resid = F.col("_y") - F.lit(float(fit.coef[0])) - weighted_sum([F.col(c) for c in design.columns], fit.coef[1:])
    return z, resid


def _sum_outer(d: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sum over rows of the outer product of the columns."""
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    r = d.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i, j in upper]).first()
    out = np.zeros((k, k))
    for i, j in upper:
        out[i, j] = out[j, i] = float(r[f"s{i}_{j}"] or 0.0)
    return out


def hc3(design: Design, fit: LinearFit, weight: str | None = None) -> LinearFit:
    """Heteroskedasticity-robust covariance with leverage-squared correction."""
    z, e = _centred_design(design, fit)
    w = F.col(weight) if weight else F.lit(1.0)
    d = design.data.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], e.alias("e"), w.alias("w"))
    zc = [F.col(f"z{i}") for i in range(len(z))]
    lever = F.col("w") * sum((zc[i] * weighted_sum(zc, fit.bread[i]) for i in range(len(zc))), F.lit(0.0))
    u = d.withColumn("u", F.col("w") * F.col("e") / (1 - lever)).select(*[(c * F.col("u")).alias(f"u{i}") for i, c in enumerate(zc)])
    meat = _sum_outer(u, u.columns)
    return _with_vcov(fit, fit.bread @ meat @ fit.bread, "HC3", fit.df)


def _with_vcov(fit: LinearFit, centred: np.ndarray, kind: str, df: int, clusters: int | None = None) -> LinearFit:
    return LinearFit(fit.names, fit.n, fit.coef, fit.bread, fit.means, fit.to_raw, fit.rss, fit.tss, fit.weight_sum, fit.s_xx,
                     fit.to_raw @ centred @ fit.to_raw.T, kind, df, clusters)


def cluster_meat(d: DataFrame, z: Sequence[Column], resid: Column, weight: Column | None, cluster: str, bread: np.ndarray, kind: str) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of the cluster scores, and the number of clusters.

    CR2 adjusts each cluster's residuals by the inverse root of M = I - XU' - UX' + X(U'U)X'.
    With Z = [X U] this is I + Z C Z', so the adjusted score needs only cluster sums of
    products (a few k x k matrices per cluster), never a matrix of the cluster's size.
    """
    k = len(z)
    w = F.lit(1.0) if weight is None else weight
    base = d.select(F.col(cluster).alias("_g"), *[c.alias(f"z{i}") for i, c in enumerate(z)], resid.alias("e"), w.alias("w"))
    zc = [F.col(f"z{i}") for i in range(k)]
    score = [F.sum(F.col("w") * c * F.col("e")).alias(f"s{i}") for i, c in enumerate(zc)]
    if kind in ("CR0", "CR1"):
        g = base.groupBy("_g").agg(*score)
        upper = [(i, j) for i in range(k) for j in range(i, k)]
        r = g.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in upper]).first()
        meat = np.zeros((k, k))
        for i, j in upper:
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
        return meat, r["g"]
    if kind != "CR2":
        raise ValueError("kind must be CR0, CR1 or CR2")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    grams = [F.sum(F.pow(F.col("w"), F.lit(float(p))) * zc[i] * zc[j]) for p in ((0, 1, 2) if weight is not None else (0,)) for i, j in upper]
    plain = [F.sum(c * F.col("e")) for c in zc]
    g = base.groupBy("_g").agg(F.array(*grams).alias("gram"), F.array(*plain).alias("xe"), F.array(*[F.sum(F.col("w") * c * F.col("e")) for c in zc]).alias("xwe"))
    weighted, b = weight is not None, bread
    total_uu = b
    if weighted:
        total_uu = b @ _sum_outer(base.select(*[(F.col("w") * c).alias(f"u{i}") for i, c in enumerate(zc)]), [f"u{i}" for i in range(k)]) @ b

    def adjusted(batches):
        iu = np.triu_indices(k)
        for pdf in batches:
            if not len(pdf):
                continue
            packed = np.stack(pdf["gram"].to_numpy())
            mats = []
            for part in np.split(packed, packed.shape[1] // len(iu[0]), axis=1):
                m = np.zeros((len(pdf), k, k))
                m[:, iu[0], iu[1]] = part
                m[:, iu[1], iu[0]] = part
                mats.append(m)
            xx, xwx, xwwx = mats if weighted else (mats[0], mats[0], mats[0])
            xe, xwe = np.stack(pdf["xe"].to_numpy()), np.stack(pdf["xwe"].to_numpy())
            s = cr2_scores(xx, xwx, xwwx, xe, xwe, b, total_uu)
            outer = np.einsum("gi,gj->ij", s, s)
            yield pd.DataFrame({"i": np.arange(k * k), "v": outer.ravel(), "g": np.where(np.arange(k * k) == 0, len(pdf), 0)})

    total = g.mapInPandas(adjusted, "i int, v double, g long").groupBy("i").agg(F.sum("v").alias("v"), F.sum("g").alias("g")).collect()
    meat = np.zeros(k * k)
    for r in total:
        meat[r["i"]] = r["v"]
    return meat.reshape(k, k), int(sum(r["g"] for r in total))


def cr2_scores(xx, xwx, xwwx, xe, xwe, bread, total_uu) -> np.ndarray:
    """Bias-reduced cluster scores from stacked cluster sums (clusters x k x k)."""
    g, k, _ = xx.shape
    xu = xwx @ bread
    uu = bread @ xwwx @ bread
    zz = np.concatenate([np.concatenate([xx, xu], 2), np.concatenate([xu.transpose(0, 2, 1), uu], 2)], 1)
    ze = np.concatenate([xe, xwe @ bread], 1)
    xwz = np.concatenate([xwx, xwwx @ bread], 2)
    c = np.zeros((2 * k, 2 * k))
    c[:k, :k] = total_uu
    c[:k, k:] = c[k:, :k] = -np.eye(k)
    val, vec = np.linalg.eigh((zz + zz.transpose(0, 2, 1)) / 2)
    ok = val > 1e-10 * np.maximum(val[:, -1:], 1e-300)
    root = np.where(ok, np.sqrt(np.where(ok, val, 1.0)), 0.0)
    inv = np.where(ok, 1.0 / np.where(ok, root, 1.0), 0.0)
    kk = root[:, :, None] * (vec.transpose(0, 2, 1) @ c @ vec) * root[:, None, :]
    mval, mvec = np.linalg.eigh(np.eye(2 * k) + (kk + kk.transpose(0, 2, 1)) / 2)
    f = np.where(mval > 1e-12, 1.0 / np.sqrt(np.where(mval > 1e-12, mval, 1.0)), 0.0) - 1.0
    q = np.einsum("gij,gi->gj", vec, ze) * inv
    q = np.einsum("gij,gj->gi", mvec, f * np.einsum("gij,gi->gj", mvec, q))
    return xwe + np.einsum("gij,gj->gi", xwz, np.einsum("gij,gj->gi", vec, q * inv))


def cluster_robust(design: Design, fit: LinearFit, cluster: str = "_g0", kind: str = "CR1", weight: str | None = None) -> LinearFit:
    """CR0, CR1 or CR2 covariance; t-tests use (clusters - 1) degrees of freedom."""
    d = design.data.where(F.col(weight) > 0) if weight else design.data
    z, e = _centred_design(design, fit)
    meat, g = cluster_meat(d, z, e, F.col(weight) if weight else None, cluster, fit.bread, kind)
    v = fit.bread @ meat @ fit.bread
    if kind == "CR1":
        v = v * (g / (g - 1)) * ((fit.n - 1) / (fit.n - fit.k))
    return _with_vcov(fit, v, kind, max(g - 1, 1), g)


def coefficient_rows(fit: LinearFit) -> list[tuple]:
    out = []
    for j, name in enumerate(fit.names):
        c = np.zeros(fit.k)
        c[j] = 1.0
        r = fit.contrast(c)
        out.append((name, r["estimate"], r["se"], r["t"], int(r["df"]), r["p"], r["ci_low"], r["ci_high"]))
    return out


COEF_SCHEMA = "term string, b double, se double, t double, df int, p double, ci_low double, ci_high double"


def standardized(fit: LinearFit) -> dict[str, float]:
    sd_y = np.sqrt(fit.tss)
    return {n: float(fit.coef[j] * np.sqrt(fit.s_xx[j - 1, j - 1]) / sd_y) for j, n in enumerate(fit.names) if j}


def vif(fit: LinearFit) -> dict[str, float]:
    """Variance inflation from the centred cross-products; the design contains the intercept."""
    inv = np.linalg.pinv(fit.s_xx)
    return {n: float(inv[j - 1, j - 1] * fit.s_xx[j - 1, j - 1]) for j, n in enumerate(fit.names) if j}


def model_row(fit: LinearFit) -> tuple:
    p, dfr = fit.k - 1, fit.n - fit.k
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else float("nan")
    f = (fit.tss - fit.rss) / p / (fit.rss / dfr) if p and dfr > 0 and fit.rss > 0 else float("nan")
    pf = float(dist.f_sf([f], [float(p)], [float(dfr)])[0]) if np.isfinite(f) else float("nan")
    return (fit.n, r2, 1 - (1 - r2) * (fit.n - 1) / dfr, f, p, dfr, pf, float(np.sqrt(fit.rss / dfr)), fit.kind, fit.clusters)


MODEL_SCHEMA = "n long, r2 double, adj_r2 double, f double, df1 int, df2 long, p double, rmse double, errors string, clusters long"


@analysis("regression_linear", "Linear regression", "Regression")
def regression_linear(df: DataFrame, y: str, x=None, categorical=None, se: str = "classical", cluster: str | None = None, weight: str | None = None) -> Result:
    """Coefficients with classical, HC3, CR0, CR1 or CR2 errors; model summary; variance inflation."""
    extra = ({"_g0": cluster} if cluster else {}) | ({"_w": number(weight)} if weight else {})
    design = build_design(df, number(y), as_list(x), as_list(categorical), extra)
    w = "_w" if weight else None
    fit = fit_linear(design, w)
    if se == "HC3":
        fit = hc3(design, fit, w)
    elif se in ("CR0", "CR1", "CR2"):
        if not cluster:
            raise ValueError(f"{se} errors need a cluster column")
        fit = cluster_robust(design, fit, "_g0", se, w)
    elif se != "classical":
        raise ValueError(f"unknown kind of standard error {se!r}")
    spark = df.sparkSession
    beta = standardized(fit) if not weight else {}
    coefs = [(*r, beta.get(r[0])) for r in coefficient_rows(fit)]
    return Result({
        "coefficients": small_table(spark, coefs, COEF_SCHEMA + ", beta double"),
        "model": small_table(spark, [model_row(fit)], MODEL_SCHEMA),
        "vif": small_table(spark, list(vif(fit).items()), "term string, vif double"),
    })


@analysis("linear_contrast", "Linear contrast", "Regression")
def linear_contrast(df: DataFrame, y: str, contrast: Mapping[str, float], x=None, categorical=None, se: str = "classical", cluster: str | None = None, weight: str | None = None) -> DataFrame:
    """Estimate, error, t, p and interval of a weighted sum of coefficients; ``contrast`` maps terms to weights, the rest weigh 0."""
    extra = ({"_g0": cluster} if cluster else {}) | ({"_w": number(weight)} if weight else {})
    design = build_design(df, number(y), as_list(x), as_list(categorical), extra)
    w = "_w" if weight else None
    fit = fit_linear(design, w)
    if se == "HC3":
        fit = hc3(design, fit, w)
    elif se != "classical":
        fit = cluster_robust(design, fit, "_g0", se, w)
    names = list(fit.names)
    unknown = sorted(set(contrast) - set(names))
    if unknown:
        raise ValueError(f"terms not in the model: {unknown}; available: {names}")
    r = fit.contrast([float(contrast.get(n, 0.0)) for n in names])
    keys = ("estimate", "se", "t", "df", "p", "ci_low", "ci_high")
    return small_table(df.sparkSession, [tuple(float(r[k]) for k in keys)], ", ".join(f"{k} double" for k in keys))


@analysis("incremental_validity", "Incremental validity", "Measurement")
def incremental_validity(df: DataFrame, outcome: str, base, focal, cluster: str | None = None) -> Result:
    """R-squared change of the focal predictors over the baseline ones; both models from one cross-product matrix."""
    base, focal = as_list(base), as_list(focal)
    if not focal:
        raise ValueError("name at least one focal predictor")
    design = build_design(df, number(outcome), [*base, *focal], extra={"_g0": cluster} if cluster else None)
    n, sw, means, s = _centred_products(design.data, [*design.columns, "_y"], None)
    full = _solve(design.names, n, sw, means, s)
    keep = [*range(len(base)), len(design.names)]
    small = _solve(base, n, sw, means[keep], s[np.ix_(keep, keep)])
    fit = cluster_robust(design, full, "_g0", "CR1") if cluster else hc3(design, full)
    r0, r1 = 1 - small.rss / small.tss, 1 - full.rss / full.tss
    d1, d2 = len(focal), full.df
    f = (r1 - r0) / d1 / ((1 - r1) / d2) if d2 > 0 and r1 < 1 else float("nan")
    p = float(dist.f_sf([f], [float(d1)], [float(d2)])[0]) if np.isfinite(f) else float("nan")
    return Result({
        "comparison": small_table(df.sparkSession, [(n, r0, r1, r1 - r0, f, d1, d2, p)],
                                  "n long, base_r2 double, full_r2 double, delta_r2 double, f_change double, df1 int, df2 long, p double"),
        "coefficients": small_table(df.sparkSession, coefficient_rows(fit), COEF_SCHEMA),
    })


@analysis("panel_first_difference", "First-difference panel model", "Panel")
def panel_first_difference(df: DataFrame, y1: str, y2: str, pairs: Mapping[str, Sequence[str]], cluster: str | None = None) -> Result:
    """Change on change; cluster-robust when the ids repeat, HC3 otherwise."""
    if not pairs:
        raise ValueError("give at least one predictor pair")
    diffs = {f"d_{k}": c for k, c in first_difference(pairs).items()}
    design = build_design(df, number(y2) - number(y1), extra={"_g0": cluster} if cluster else None, terms=diffs)
    fit = fit_linear(design)
    repeated = bool(cluster) and design.data.select("_g0").distinct().count() < fit.n
    fit = cluster_robust(design, fit, "_g0", "CR1") if repeated else hc3(design, fit)
    m = model_row(fit)
    return Result({
        "coefficients": small_table(df.sparkSession, coefficient_rows(fit), COEF_SCHEMA),
        "model": small_table(df.sparkSession, [(fit.n, m[1], m[2], float(fit.means[-1]), float(np.sqrt(fit.tss / (fit.n - 1))), fit.kind)],
                             "n long, r2 double, adj_r2 double, mean_change double, sd_change double, errors string"),
    })


@analysis("conjoint_amce", "Conjoint component effects", "Choice")
def conjoint_amce(df: DataFrame, attributes, chosen: str, respondent: str, factor: str | None = None, interact=None,
                  baselines: Mapping[str, str] | None = None, factor_baseline: str | None = None, task: str = "task", errors: str = "CR2") -> Result:
    """Average component effects, and their interactions with a task-level factor, clustered by respondent."""
    attrs = as_list(attributes)
    spark = df.sparkSession
    # read several times below: level lists, two designs, two passes each
    df = materialize(df.select(*dict.fromkeys([*attrs, chosen, respondent, *([factor, task] if factor else [])])), "profiles")
    design = build_design(df, number(chosen), categorical=attrs, extra={"_g0": respondent}, baselines=baselines)
    out = {"amce": small_table(spark, coefficient_rows(cluster_robust(design, fit_linear(design), "_g0", errors)), COEF_SCHEMA)}
    if factor:
        keep = as_list(interact) or attrs
        dummies: dict[str, Column] = {}
        for a in attrs:
            dummies |= dummy_columns(a, text_levels(df, a), (baselines or {}).get(a))
        flags = dummy_columns(factor, text_levels(df, factor), factor_baseline)
        terms = dummies | flags | {f"{n} x {f}": c * e for n, c in dummies.items() if n.split("=", 1)[0] in keep for f, e in flags.items()}
        whole = build_design(df, number(chosen), extra={"_g0": respondent}, terms=terms)
        rows = coefficient_rows(cluster_robust(whole, fit_linear(whole), "_g0", errors))
        out["interaction_model"] = small_table(spark, rows, COEF_SCHEMA)
        out["interactions"] = small_table(spark, [r for r in rows if " x " in r[0]], COEF_SCHEMA)
        out["reject_both_rate"] = reject_both_rate(df, chosen, respondent, factor, task)
    out["info"] = df.agg(F.count(F.lit(1)).alias("profile_rows"), F.count_distinct(respondent).alias("respondents"), F.lit(errors).alias("errors"))
    return Result(out)


def reject_both_rate(df: DataFrame, chosen: str, respondent: str, factor: str, task: str = "task") -> DataFrame:
    """Share of tasks in which no profile was chosen, by the level of the task's factor."""
    tasks = df.groupBy(respondent, task).agg(F.max(number(chosen)).alias("any_chosen"), F.min(F.col(factor).cast("string")).alias("factor_level"))
    return tasks.groupBy("factor_level").agg((1 - F.avg("any_chosen")).alias("reject_both_rate"), F.count(F.lit(1)).alias("tasks"))


@analysis("design_diagnostics", "Design diagnostics", "Choice")
def design_diagnostics(df: DataFrame, attributes: Mapping[str, Sequence[str]] | Sequence[str] | str, factor: str | None = None, block: str | None = None) -> Result:
    """Level balance against equal shares, association of attribute pairs, and the task factor by block."""
    declared = attributes if isinstance(attributes, Mapping) else None
    attrs = list(declared) if declared else as_list(attributes)
    balance = frequencies(df, attrs).where("level not in ('Total', 'Missing')").withColumnRenamed("variable", "attribute")
    if declared:
        expected = F.create_map(*[F.lit(v) for a in attrs for v in (a, 1.0 / len(declared[a]))])[F.col("attribute")]
    else:
        from pyspark.sql.window import Window as W

        expected = 1.0 / F.count(F.lit(1)).over(W.partitionBy("attribute"))
    out = {"balance": balance.select("attribute", "level", (F.col("valid_percent") / 100).alias("share"), expected.alias("expected"))}
    pairs = list(combinations(attrs, 2))
    if pairs:
        parts = [contingency(df, a, b).withColumns({"first": F.lit(a), "second": F.lit(b)}) for a, b in pairs]
        cells = parts[0]
        for p in parts[1:]:
            cells = cells.unionByName(p)
        out["association"] = association_aggregates(full_grid(cells, ["first", "second"]), ["first", "second"]).select(
            "first", "second", F.coalesce("cramers_v", F.lit(0.0)).alias("cramers_v"))
    if factor and block:
        # two profiles per task
        out["factor_by_block"] = contingency(df, block, factor).select(
            F.col("row").alias("block"), F.col("col").alias("factor_level"), (F.col("n") / 2).alias("tasks"))
    return Result(out)


def performance(df: DataFrame, estimate: str, se: str, low: str, high: str, p: str, truth: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Bias, errors, coverage and rejection rate over a table of replicate results, with Monte Carlo errors."""
    e, s, t = number(estimate), number(se), number(truth)
    ok = e.isNotNull() & s.isNotNull()
    d = df.select(
        *by, F.when(ok, e).alias("e"), F.when(ok, s).alias("s"), F.when(ok, t).alias("t"),
        F.when(ok, ((number(low) <= t) & (t <= number(high))).cast("double")).alias("cover"), F.when(ok, (number(p) < alpha).cast("double")).alias("reject"))
    n, tried = F.count("e"), F.count(F.lit(1))
    err = F.col("e") - F.col("t")
    emp, mod = F.stddev_samp("e"), F.sqrt(F.avg(F.col("s") * F.col("s")))
    mc = lambda c: F.sqrt(F.avg(c) * (1 - F.avg(c)) / F.count(c))
    many = lambda c: F.when(n >= 2, c)
    rate = n / tried
    return d.groupBy(*by).agg(
        n.alias("replicates"), tried.alias("attempted"), rate.alias("estimable_rate"), F.sqrt(rate * (1 - rate) / tried).alias("estimable_rate_mcse"),
        many(F.avg("e")).alias("mean_estimate"), many(F.avg(err)).alias("bias"), many(emp / F.sqrt(n)).alias("bias_mcse"),
        many(emp).alias("empirical_se"), many(emp / F.sqrt(2 * (n - 1))).alias("empirical_se_mcse"),
        many(mod).alias("model_se"), many(F.when(emp > 0, 100 * (mod / emp - 1))).alias("model_se_error_percent"), many(F.sqrt(F.avg(err * err))).alias("rmse"),
        many(F.avg("cover")).alias("coverage"), many(mc("cover")).alias("coverage_mcse"),
        many(F.avg("reject")).alias("rejection"), many(mc("reject")).alias("rejection_mcse"))
