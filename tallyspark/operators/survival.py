"""Cox regression with Efron ties, and the product-limit curve, from sums per distinct time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions.columns import as_list, number
from tallyspark.operators.glm import MlFit, Z_SCHEMA, _z_rows, newton
from tallyspark.operators.linear import weighted_sum
from tallyspark.operators.order_stats import running_counts
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table


def _checked(df: DataFrame, duration: str, status: str, covariates: Sequence[str], cluster: str | None) -> DataFrame:
    t, s = number(duration), number(status)
    t = F.when(t > 0, t).when(t.isNotNull(), F.raise_error(F.lit("durations must be > 0")).cast("double"))
    s = F.when(s.isin(0.0, 1.0), s).when(s.isNotNull(), F.raise_error(F.lit("status must be 0 or 1")).cast("double"))
    cols = [t.alias("t"), s.alias("d"), *[number(c).alias(f"x{i}") for i, c in enumerate(covariates)]]
    return df.select(*cols, *([F.col(cluster).alias("_g0")] if cluster else [])).dropna()


def _time_ranges(data: DataFrame) -> DataFrame:
    """Every distinct time with a range partition number, fixed by writing it."""
    return materialize(data.select("t").distinct().repartitionByRange("t").withColumn("part", F.spark_partition_id()), "times")


def _at_risk(per_time: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Adds the total over this and all later times of every sum, through partition totals."""
    parts = per_time.groupBy("part").agg(*[F.sum(s).alias(f"{s}_p") for s in sums])
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)  # one row per range partition
    offset = parts.select("part", *[F.coalesce(F.sum(f"{s}_p").over(later), F.lit(0.0)).alias(f"{s}_o") for s in sums])
    inside = W.partitionBy("part").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0)
    j = per_time.join(offset, "part")
    return j.withColumns({f"R_{s}": F.col(f"{s}_o") + F.sum(s).over(inside) for s in sums}).drop(*[f"{s}_o" for s in sums])


def _cox_sums(data: DataFrame, beta: np.ndarray, block: int = 100_000) -> tuple[float, np.ndarray, np.ndarray]:
    """Efron partial log-likelihood, gradient and Hessian at one coefficient vector."""
    k = len(beta)
    x = [F.col(f"x{i}") for i in range(k)]
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    eta = weighted_sum(x, beta)
    d = data.withColumn("eta", eta).withColumn("e", F.exp("eta"))
    sums = {"s0": F.col("e")} | {f"s1_{i}": F.col("e") * x[i] for i in range(k)} | {f"s2_{i}_{j}": F.col("e") * x[i] * x[j] for i, j in upper}
    on = F.col("d") == 1
    aggs = [F.sum(c).alias(n) for n, c in sums.items()] + [F.sum(F.when(on, c).otherwise(0.0)).alias(f"e_{n}") for n, c in sums.items()]
    aggs += [F.sum("d").alias("m"), F.sum(F.when(on, F.col("eta")).otherwise(0.0)).alias("eta_d")] + [F.sum(F.when(on, x[i]).otherwise(0.0)).alias(f"x_d{i}") for i in range(k)]
    per = d.groupBy("part", "t").agg(*aggs)
    r = _at_risk(per, list(sums)).where("m > 0")
    # Efron: the l-th of m tied events sees the risk set less l/m of the events; only six sums over l are needed
    l_from = r.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1, F.lit(block).cast("long"))))
    ls = l_from.select("t", "R_s0", "e_s0", "m", F.explode(F.sequence("start", F.least(F.col("start") + block, F.col("m").cast("long")) - 1)).alias("l"))
    f = F.col("l") / F.col("m")
    phi = 1 / (F.col("R_s0") - f * F.col("e_s0"))
    six = ls.groupBy("t").agg(F.sum(-F.log(phi)).alias("log_den"), F.sum(phi).alias("p1"), F.sum(f * phi).alias("p1f"), F.sum(phi * phi).alias("p2"), F.sum(f * phi * phi).alias("p2f"), F.sum(f * f * phi * phi).alias("p2ff"))
    z = r.join(six, "t")
    S, E = (lambda n: F.col(f"R_{n}")), (lambda n: F.col(f"e_{n}"))
    out = [F.sum(F.col("eta_d") - F.col("log_den")).alias("ll")]
    out += [F.sum(F.col(f"x_d{i}") - (S(f"s1_{i}") * F.col("p1") - E(f"s1_{i}") * F.col("p1f"))).alias(f"g{i}") for i in range(k)]
    for i, j in upper:
        a, b, c, e = S(f"s1_{i}"), E(f"s1_{i}"), S(f"s1_{j}"), E(f"s1_{j}")
        second = S(f"s2_{i}_{j}") * F.col("p1") - E(f"s2_{i}_{j}") * F.col("p1f")
        cross = a * c * F.col("p2") - (a * e + b * c) * F.col("p2f") + b * e * F.col("p2ff")
        out.append(F.sum(-(second - cross)).alias(f"h{i}_{j}"))
    v = z.agg(*out).first()
    h = np.zeros((k, k))
    for i, j in upper:
        h[i, j] = h[j, i] = v[f"h{i}_{j}"]
    return float(v["ll"]), np.array([v[f"g{i}"] for i in range(k)], float), h


def _score_meat(data: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, int]:
    """Outer products of the cluster sums of the score residuals, with the Breslow form of the risk-set weights."""
    k = len(beta)
    x = [F.col(f"x{i}") for i in range(k)]
    d = data.withColumn("e", F.exp(weighted_sum(x, beta)))
    sums = {"s0": F.col("e")} | {f"s1_{i}": F.col("e") * x[i] for i in range(k)}
    per = d.groupBy("part", "t").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.sum("d").alias("m"))
    r = _at_risk(per, list(sums))
    haz = {"h0": F.col("m") / F.col("R_s0")} | {f"h1_{i}": F.col("m") * F.col(f"R_s1_{i}") / (F.col("R_s0") * F.col("R_s0")) for i in range(k)}
    r = r.select("part", "t", *[c.alias(n) for n, c in haz.items()], *[(F.col(f"R_s1_{i}") / F.col("R_s0")).alias(f"xb{i}") for i in range(k)])
    # running totals over this and all earlier times: total minus later plus own
    total = r.agg(*[F.sum(n).alias(f"T_{n}") for n in haz])
    later = _at_risk(r, list(haz)).join(total, F.lit(True))
    cum = later.select("t", *[(F.col(f"T_{n}") - F.col(f"R_{n}") + F.col(n)).alias(f"C_{n}") for n in haz], *[f"xb{i}" for i in range(k)])
    u = d.join(cum, "t").select("_g0", *[(F.col("d") * (x[i] - F.col(f"xb{i}")) - F.col("e") * (x[i] * F.col("C_h0") - F.col(f"C_h1_{i}"))).alias(f"u{i}") for i in range(k)])
    g = u.groupBy("_g0").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)])
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    v = g.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in upper]).first()
    m = np.zeros((k, k))
    for i, j in upper:
        m[i, j] = m[j, i] = v[f"m{i}_{j}"]
    return m, v["g"]


def product_limit(df: DataFrame, duration: str, status: str) -> DataFrame:
    """Events, number at risk and survival probability at every distinct event time."""
    d = _checked(df, duration, status, [], None)
    per = d.join(_time_ranges(d), "t").groupBy("part", "t").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("d").alias("events"))
    r = _at_risk(per, ["n"]).select("t", F.col("R_n").cast("long").alias("at_risk"), F.col("events").cast("long").alias("events"))
    r = materialize(r.where("events > 0"), "risk")
    # log survival is a running sum over times: the same prefix sums as for ranks
    logs = running_counts(r, "t", weights={"v": F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0), "z": F.when(F.col("events") >= F.col("at_risk"), 1).otherwise(0)})
    s = logs.select(F.col("value").alias("t"), F.when(F.col("z_before") + F.col("z") > 0, 0.0).otherwise(F.exp(F.col("v_before") + F.col("v"))).alias("survival"))
    return r.join(s, "t")


@analysis("cox_ph", "Cox proportional hazards", "Survival")
def cox_ph(df: DataFrame, duration: str, status: str, covariates, cluster: str | None = None) -> Result:
    """Hazard ratios with Efron ties, cluster-robust if asked, the survival curve and its median."""
    covs = as_list(covariates)
    d = _checked(df, duration, status, covs, cluster)
    data = materialize(d.join(_time_ranges(d), "t"), "cox")
    means = data.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(covs))]).first()
    centred = data.withColumns({f"x{i}": F.col(f"x{i}") - F.lit(float(means[i])) for i in range(len(covs))})
    fit: MlFit = newton(lambda b: _cox_sums(centred, b), np.zeros(len(covs)), max_iter=20)
    v, g = fit.vcov, None
    if cluster:
        meat, g = _score_meat(centred, fit.theta)
        v = v @ meat @ v
    curve = product_limit(df, duration, status)
    med = curve.where("survival <= 0.5").agg(F.min("t").alias("median_survival"))
    n = data.agg(F.count(F.lit(1)).alias("n"), F.sum("d").cast("long").alias("events"), F.sum(1 - F.col("d")).cast("long").alias("censored"))
    model = n.join(med, F.lit(True)).withColumns({"loglik": F.lit(fit.loglik), "converged": F.lit(fit.converged), "clusters": F.lit(g).cast("long")})
    return Result({"coefficients": small_table(df.sparkSession, _z_rows(covs, fit.theta, np.sqrt(np.maximum(np.diag(v), 0))), Z_SCHEMA), "model": model, "curve": curve})
