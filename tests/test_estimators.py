"""Estimators against independent NumPy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import choice, correlate, glm, linear, overlap, survival
from tallyspark.operators.describe import descriptives
from tallyspark.operators.order_stats import row_numbers

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def table(spark):
    n = 240
    x1, x2 = RNG.normal(size=n), RNG.normal(3, 2, size=n)
    g = RNG.integers(0, 12, size=n)
    w = RNG.uniform(0.5, 3, size=n)
    y = 1 + 0.5 * x1 - 0.3 * x2 + RNG.normal(size=12)[g] + RNG.normal(size=n)
    a = {"x1": x1, "x2": x2, "g": g, "w": w, "y": y}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x1, x2, g, w, y)], "x1 double, x2 double, g double, w double, y double")
    return df, a


def dense_cr2(y, x, g, w):
    b = np.linalg.inv(x.T @ (x * w[:, None]))
    e = y - x @ (b @ (x.T @ (w * y)))
    u = (x * w[:, None]) @ b
    uu = u.T @ u
    meat = np.zeros((x.shape[1],) * 2)
    for k in np.unique(g):
        i = g == k
        m = np.eye(i.sum()) - x[i] @ u[i].T - u[i] @ x[i].T + x[i] @ uu @ x[i].T
        val, vec = np.linalg.eigh((m + m.T) / 2)
        a = (vec * np.where(val > 1e-12, 1 / np.sqrt(np.clip(val, 1e-12, None)), 0)) @ vec.T
        s = x[i].T @ (w[i] * (a @ e[i]))
        meat += np.outer(s, s)
    return np.sqrt(np.diag(b @ meat @ b))


@pytest.mark.parametrize("weighted", [False, True])
def test_cr2_equals_dense_form(table, weighted):
    df, a = table
    t = linear.regression_linear(df, "y", "x1,x2", se="CR2", cluster="g", weight="w" if weighted else None)["coefficients"].collect()
    x = np.column_stack([np.ones(len(a["y"])), a["x1"], a["x2"]])
    assert [r["se"] for r in t] == pytest.approx(dense_cr2(a["y"], x, a["g"], a["w"] if weighted else np.ones(len(x))), rel=1e-9)


def test_cr2_of_singletons_is_hc2(table):
    df, a = table
    d = df.withColumn("id", F.monotonically_increasing_id())
    t = linear.regression_linear(d, "y", "x1,x2", se="CR2", cluster="id")["coefficients"].collect()
    x = np.column_stack([np.ones(len(a["y"])), a["x1"], a["x2"]])
    b = np.linalg.inv(x.T @ x)
    e = a["y"] - x @ b @ x.T @ a["y"]
    h = np.einsum("ij,jk,ik->i", x, b, x)
    hc2 = b @ (x * (e ** 2 / (1 - h))[:, None]).T @ x @ b
    assert [r["se"] for r in t] == pytest.approx(np.sqrt(np.diag(hc2)), rel=1e-9)


def test_logistic_score_is_zero(table):
    df, a = table
    d = df.withColumn("e", (F.col("y") > 0).cast("int"))
    t = glm.regression_logistic(d, "e", "x1,x2")["coefficients"].collect()
    x, y = np.column_stack([np.ones(len(a["y"])), a["x1"], a["x2"]]), (a["y"] > 0).astype(float)
    b = np.array([r["b"] for r in t])
    p = 1 / (1 + np.exp(-x @ b))
    assert x.T @ (y - p) == pytest.approx(np.zeros(3), abs=1e-6)
    assert [r["se"] for r in t] == pytest.approx(np.sqrt(np.diag(np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x))), rel=1e-6)


def test_ordinal_gradient_by_differences():
    x, z = RNG.normal(size=(50, 2)), RNG.integers(0, 4, size=50)
    block, th, k = np.column_stack([z, x]), np.array([0.2, -0.4, -1.0, 0.1, 1.2]), glm.ordinal_kernel(4)
    ll, g, h = k(block, th)
    step = 1e-5
    for j in range(5):
        e = np.eye(5)[j] * step
        assert g[j] == pytest.approx((k(block, th + e)[0] - k(block, th - e)[0]) / (2 * step), rel=1e-5, abs=1e-6)
        assert h[j] == pytest.approx((k(block, th + e)[1] - k(block, th - e)[1]) / (2 * step), rel=1e-4, abs=1e-5)


def efron(t, d, x, b):
    e = np.exp(x @ b)
    ll = 0.0
    for u in np.unique(t[d == 1]):
        risk, ev = t >= u, (t == u) & (d == 1)
        m = ev.sum()
        ll += (x[ev] @ b).sum() - sum(np.log(e[risk].sum() - i / m * e[ev].sum()) for i in range(m))
    return ll


def test_cox_efron(spark):
    n = 120
    x = RNG.normal(size=(n, 2))
    t = np.ceil(RNG.exponential(np.exp(-0.7 * x[:, 0])) * 6)
    d = (RNG.uniform(size=n) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(e)) for a, b, (c, e) in zip(t, d, x)], "t double, d int, x1 double, x2 double")
    r = survival.cox_ph(df, "t", "d", "x1,x2")
    b = np.array([q["b"] for q in r["coefficients"].collect()])
    xc = x - x.mean(axis=0)
    best = efron(t, d, xc, b)
    assert r["model"].first()["loglik"] == pytest.approx(best, abs=1e-7)
    for j in range(2):
        for s in (1e-3, -1e-3):
            assert efron(t, d, xc, b + np.eye(2)[j] * s) < best


def test_mnl_and_mixed_logit(spark):
    rows, u = [], {"a": 0.0, "b": 0.8, "c": -0.5}
    for r in range(40):
        for k in range(4):
            lv = RNG.choice(list("abc"), 2)
            util = np.array([u[v] for v in lv] + [-0.3]) + RNG.gumbel(size=3)
            rows += [(r, k, j, str(lv[j]), int(np.argmax(util) == j), "hi" if k % 2 else "lo") for j in range(2)]
    df = spark.createDataFrame(rows, "respondent int, task int, profile int, attr string, chosen int, f string")
    c = choice.prepare_choice(df, "attr", "chosen", "respondent")
    fit = choice.fit_mnl(c)
    pdf = c.data.toPandas()
    x = pdf[c.columns].to_numpy()

    def ll(b):
        e = np.exp(x @ b)
        den = pdf.assign(e=e).groupby("set_id")["e"].transform("sum")
        return float((pdf["y"] * np.log(e / den)).sum())

    assert fit.converged and fit.loglik == pytest.approx(ll(fit.theta), abs=1e-8)
    for j in range(len(fit.theta)):
        for s in (1e-3, -1e-3):
            assert ll(fit.theta + np.eye(len(fit.theta))[j] * s) < fit.loglik
    m = choice.mixed_logit(df, "attr", "chosen", "respondent", "outside", draws=32, max_iter=8)["model"].first()
    assert m["loglik"] >= m["loglik_mnl"] - 1.0
    sl = choice.swait_louviere(df, "attr", "chosen", "respondent", factor="f")["test"].first()
    assert sl["loglik_separate"] >= sl["loglik_scaled"] - 1e-6 >= sl["loglik_pooled"] - 2e-6
    bad = df.withColumn("chosen", F.lit(1))
    with pytest.raises(ValueError, match="more than one"):
        choice.prepare_choice(bad, "attr", "chosen", "respondent")


def test_two_arm_overlap_weights_balance_exactly(spark, table):
    df, a = table
    d = df.withColumn("arm", F.when(F.col("x1") + F.col("x2") > 3, "A").otherwise(F.when(F.col("w") > 1.5, "A").otherwise("B")))
    b = overlap.balance_table(overlap.propensity(d, "arm", "x1,x2", "g")).collect()
    assert max(r["max_smd_weighted"] for r in b) < 1e-5
    with pytest.raises(ValueError, match="sum to 0"):
        overlap.parse_contrast("A:1,B:-0.5", ["A", "B"])


def test_kendall_against_pairs(spark):
    x, y = RNG.integers(0, 9, size=70), RNG.integers(0, 6, size=70)
    r = correlate.correlation(spark.createDataFrame([(float(p), float(q)) for p, q in zip(x, y)], "x double, y double"), "x,y", "kendall").first()
    s = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
    n0, tx, ty = 70 * 69 / 2, sum(c * (c - 1) / 2 for c in np.bincount(x)), sum(c * (c - 1) / 2 for c in np.bincount(y))
    assert r["r"] == pytest.approx(s.sum() / 2 / np.sqrt((n0 - tx) * (n0 - ty)), abs=1e-12)


def test_quantiles_with_one_hot_group(spark):
    v = RNG.normal(size=3000).round(2)
    g = np.where(np.arange(3000) < 2000, "hot", np.array(["a", "b", "c"])[np.arange(3000) % 3])
    df = spark.createDataFrame([(str(k), float(x)) for k, x in zip(g, v)], "g string, v double")
    for r in descriptives(df, "v", by="g").collect():
        part = v[g == r["group"]]
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(np.quantile(part, [0.25, 0.5, 0.75]), abs=1e-9)
        assert r["n"] == len(part)
    num = row_numbers(df, ["g"], ["v"], "i").groupBy("g").agg(F.max("i").alias("m"), F.count_distinct("i").alias("d"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["m"] == r["d"] == r["n"] for r in num)
