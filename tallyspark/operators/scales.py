"""Scale reliability, intraclass correlation, factors, HTMT: all from one covariance pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, complete, numeric, reverse_score
from tallyspark.operators.correlate import pearson
from tallyspark.operators.linear import _centred_products
from tallyspark.registry import Result, analysis
from tallyspark.runtime import small_table


def covariance(df: DataFrame, items: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Listwise n, means and sample covariance matrix of the items (a k x k result)."""
    d = complete(numeric(df, items), items).select(*items)
    n, _, means, s = _centred_products(d, list(items), None)
    return n, means, s / (n - 1) if n > 1 else s * np.nan


def alpha_from(cov: np.ndarray) -> float | None:
    k, total = len(cov), cov.sum()
    return float(k / (k - 1) * (1 - np.trace(cov) / total)) if k > 1 and total > 0 else None


def _corr(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd)


@analysis("reliability", "Scale reliability", "Scale")
def reliability(df: DataFrame, items, reverse=None, scale_min: float = 1, scale_max: float = 5) -> Result:
    """Raw and standardised alpha, mean inter-item correlation, and item statistics."""
    its, rev = as_list(items), set(as_list(reverse))
    d = numeric(df, its)
    if rev:
        d = d.withColumns({r: reverse_score(r, scale_min, scale_max) for r in rev})
    n, means, cov = covariance(d, its)
    k, r = len(its), _corr(cov)
    rbar = float((r.sum() - k) / (k * (k - 1)))
    rows = []
    for i, name in enumerate(its):
        rest = [j for j in range(k) if j != i]
        with_rest = cov[i, rest].sum()
        rest_var = cov[np.ix_(rest, rest)].sum()
        rows.append((name, name in rev, float(means[i]), float(np.sqrt(cov[i, i])), float(with_rest / np.sqrt(cov[i, i] * rest_var)), alpha_from(cov[np.ix_(rest, rest)])))
    spark = df.sparkSession
    return Result({
        "reliability": small_table(spark, [(n, k, alpha_from(cov), k * rbar / (1 + (k - 1) * rbar), rbar)],
                                   "n long, items int, alpha double, alpha_standardized double, mean_inter_item_r double"),
        "items": small_table(spark, rows, "item string, reversed boolean, mean double, sd double, item_total_r double, alpha_if_deleted double"),
    })


@analysis("icc", "Intraclass correlation", "Scale")
def icc(df: DataFrame, raters) -> DataFrame:
    """Six intraclass correlations; the mean squares follow from the covariance matrix of the raters."""
    rs = as_list(raters)
    n, means, cov = covariance(df, rs)
    k = len(rs)
    msr = float(cov.sum() / k)
    msc = float(n * ((means - means.mean()) ** 2).sum() / (k - 1))
    within = float((n - 1) * np.trace(cov) + n * ((means - means.mean()) ** 2).sum())  # total sum of squares
    mse = (within - msr * (n - 1) - msc * (k - 1)) / ((n - 1) * (k - 1))
    msw = (within - msr * (n - 1)) / (n * (k - 1))
    rows = [
        ("ICC1", (msr - msw) / (msr + (k - 1) * msw)),
        ("ICC2", (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)),
        ("ICC3", (msr - mse) / (msr + (k - 1) * mse)),
        ("ICC1k", (msr - msw) / msr),
        ("ICC2k", (msr - mse) / (msr + (msc - mse) / n)),
        ("ICC3k", (msr - mse) / msr),
    ]
    return small_table(df.sparkSession, [(f, v, n, k) for f, v in rows], "form string, icc double, targets long, raters int")


@analysis("principal_factors", "Principal factors", "Scale")
def principal_factors(df: DataFrame, items, n_factors: int = 1) -> Result:
    """Unrotated loadings, communalities, variance explained, KMO, Bartlett's test and eigenvalues."""
    its = as_list(items)
    n, _, cov = covariance(df, its)
    r, p = _corr(cov), len(its)
    val, vec = np.linalg.eigh(r)
    val, vec = val[::-1], vec[:, ::-1]
    load = vec[:, :n_factors] * np.sqrt(np.maximum(val[:n_factors], 0))
    sign = np.where(load.sum(axis=0) < 0, -1.0, 1.0)
    load = load * sign
    inv = np.linalg.inv(r)
    partial = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(p, dtype=bool)
    r2, q2 = np.where(off, r * r, 0.0), np.where(off, partial * partial, 0.0)
    stat = -float(np.linalg.slogdet(r)[1]) * (n - 1 - (2 * p + 5) / 6)
    dof = p * (p - 1) // 2
    spark = df.sparkSession
    ss = (load ** 2).sum(axis=0)
    return Result({
        "loadings": small_table(spark, [(its[i], f + 1, float(load[i, f])) for i in range(p) for f in range(n_factors)], "item string, factor int, loading double"),
        "items": small_table(spark, [(its[i], float((load[i] ** 2).sum()), float(1 - (load[i] ** 2).sum()), float(r2[i].sum() / (r2[i].sum() + q2[i].sum()))) for i in range(p)],
                             "item string, communality double, uniqueness double, kmo double"),
        "variance": small_table(spark, [(f + 1, float(ss[f]), float(ss[f] / p), float(ss[: f + 1].sum() / p)) for f in range(n_factors)],
                                "factor int, ss_loadings double, share double, cumulative double"),
        "eigenvalues": small_table(spark, [(i + 1, float(v), float(v / p), float(val[: i + 1].sum() / p)) for i, v in enumerate(val)],
                                   "component int, eigenvalue double, share double, cumulative double"),
        "tests": small_table(spark, [(n, float(r2.sum() / (r2.sum() + q2.sum())), stat, dof, float(dist.chi2_sf([stat], [float(dof)])[0]))],
                             "n long, kmo double, bartlett double, df int, p double"),
    })


def htmt(df: DataFrame, constructs: Mapping[str, Sequence[str]]) -> DataFrame:
    """Heterotrait-monotrait ratio per pair of constructs from pairwise absolute correlations."""
    items = [i for v in constructs.values() for i in v]
    r = pearson(df, list(dict.fromkeys(items))).select("first", "second", F.abs("r").alias("r"))
    owner = small_table(df.sparkSession, [(c, i) for c, v in constructs.items() for i in v], "construct string, item string")
    a = owner.select(F.col("construct").alias("ca"), F.col("item").alias("first"))
    b = owner.select(F.col("construct").alias("cb"), F.col("item").alias("second"))
    pairs = r.join(F.broadcast(a), "first").join(F.broadcast(b), "second")
    mono = pairs.where("ca = cb").groupBy(F.col("ca").alias("construct")).agg(F.avg("r").alias("mono"))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(constructs) for x in (c, i)])
    lo = F.when(order[F.col("ca")] < order[F.col("cb")], F.col("ca")).otherwise(F.col("cb"))
    hi = F.when(order[F.col("ca")] < order[F.col("cb")], F.col("cb")).otherwise(F.col("ca"))
    het = pairs.where("ca <> cb").groupBy(lo.alias("a"), hi.alias("b")).agg(F.avg("r").alias("het"))
    ma = mono.select(F.col("construct").alias("a"), F.col("mono").alias("mono_a"))
    mb = mono.select(F.col("construct").alias("b"), F.col("mono").alias("mono_b"))
    return het.join(ma, "a", "left").join(mb, "b", "left").select("a", "b", F.try_divide(F.col("het"), F.sqrt(F.col("mono_a") * F.col("mono_b"))).alias("htmt"))


@analysis("construct_validity", "Construct validity", "Measurement")
def construct_validity(df: DataFrame, constructs: Mapping[str, Sequence[str]], loadings: Mapping[str, Sequence[float]] | None = None, htmt_cutoff: float = 0.85) -> Result:
    """Alpha per construct, composite reliability and AVE from supplied loadings, and HTMT with the pairs above the cutoff."""
    rows = []
    for name, items in constructs.items():
        if len(items) < 2:
            raise ValueError(f"construct {name!r} needs at least two items")
        n, _, cov = covariance(df, items)
        cr = ave = None
        if loadings and name in loadings:
            lam = np.asarray(loadings[name], float)
            if len(lam) != len(items):
                raise ValueError(f"loadings of {name!r} do not match its items")
            cr = float(lam.sum() ** 2 / (lam.sum() ** 2 + (1 - lam ** 2).sum()))
            ave = float((lam ** 2).mean())
        rows.append((name, len(items), n, alpha_from(cov) if n >= 3 else None, cr, ave))
    h = htmt(df, constructs).withColumn("above_cutoff", F.col("htmt") > float(htmt_cutoff))
    return Result({"reliability": small_table(df.sparkSession, rows, "construct string, items int, n long, alpha double, cr double, ave double"), "htmt": h})
