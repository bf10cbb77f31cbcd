"""The bootstrap by multiplicities against refits on copied rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators.overlap import cluster_bootstrap


def _refit(z, x, y, classes, c):
    x = np.c_[np.ones(len(x)), x]
    theta = np.zeros((classes - 1, x.shape[1]))
    for _ in range(40):
        e = np.exp(np.c_[np.zeros(len(x)), x @ theta.T])
        p = e / e.sum(1, keepdims=True)
        grad = np.concatenate([x.T @ ((z == q) - p[:, q]) for q in range(1, classes)])
        hess = np.block([[(x * (p[:, q] * ((q == r) - p[:, r]))[:, None]).T @ x for r in range(1, classes)] for q in range(1, classes)])
        theta += np.linalg.solve(hess, grad).reshape(theta.shape)
    w = 1 / (1 / p).sum(1) / p[np.arange(len(z)), z]
    return sum(c[a] * np.average(y[z == a], weights=w[z == a]) for a in range(classes))


def test_equals_refits_on_copied_rows(spark):
    rng = random.Random(2)
    rows = [(f"g{min(int(rng.expovariate(0.3)), 11)}", rng.choice("ABC"), rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(900)]
    rows = [(g, a, x, x * (1 + (a == "B")) + e) for g, a, x, e in rows]
    df = spark.createDataFrame(rows, "g string, arm string, x double, y double").repartition(3)
    n = 12
    got = {r.rep: r.estimate for r in cluster_bootstrap(df, "arm", "x", "g", "y", "B-A", replicates=n, seed=4)["estimates"].collect()}
    names = sorted({r[0] for r in rows})
    draws = spark.range(n * len(names)).select((F.col("id") / len(names)).cast("int").alias("rep"), F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(len(names))).alias("pos")).collect()
    for b in range(n):
        copied = [r for d in draws if d.rep == b for r in rows if r[0] == names[d.pos]]
        z = np.array(["ABC".index(r[1]) for r in copied])
        assert got[b] == pytest.approx(_refit(z, np.array([[r[2]] for r in copied]), np.array([r[3] for r in copied]), 3, [-1, 1, 0]), rel=1e-3, abs=1e-4)


def test_failures_are_counted(spark):
    rows = [("a", "A", 1.0, 1.0), ("a", "A", 2.0, 1.5), ("b", "B", 1.5, 2.0), ("b", "A", 0.5, 2.5), ("c", "A", 0.2, 1.0), ("c", "A", 0.7, 1.1)]
    s = cluster_bootstrap(spark.createDataFrame(rows, "g string, arm string, x double, y double"), "arm", "x", "g", "y", "B-A", replicates=40)["summary"].first()
    assert s.requested == 40 and s.arm_missing > 0 and s.successful + s.arm_missing + s.not_converged == 40
