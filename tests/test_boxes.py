"""Extremes by signs of derivatives against all corners."""

import itertools
import random
import warnings

import numpy as np
import pytest

from tallyspark.operators.bounds import bounds
from tallyspark.operators.boxes import Expression

NAMES = list("abcde")


def _random(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([*NAMES, "2.5", "1"])
    kind, part = rng.random(), lambda: _random(rng, depth - 1)
    if kind < 0.7:
        return f"({part()} {rng.choice('+-*/')} {part()})"
    return f"{rng.choice(['min', 'max', 'power'])}({part()}, {part()})" if kind < 0.85 else f"{rng.choice(['abs', 'log', 'exp', 'sqrt'])}({part()})"


def test_random_expressions_equal_all_corners():
    rng = random.Random(6)
    for _ in range(300):
        text = _random(rng, 4)
        x = Expression(text, NAMES, {})
        low = np.array([[rng.uniform(-3, 3) for _ in NAMES] for _ in range(6)])
        high = low + np.array([[rng.choice([0, rng.uniform(0, 3)]) for _ in NAMES] for _ in range(6)])
        corners = np.stack([x.values(np.where(np.array(c, bool), high, low)) for c in itertools.product([0, 1], repeat=len(NAMES))])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = np.nanmin(corners, 0), np.nanmax(corners, 0)
        assert np.allclose(x.extremes(low, high), want, rtol=1e-9, equal_nan=True), (text, low, high)


def test_forty_parameters_in_a_row(spark):
    names = [f"p{i}" for i in range(40)]
    ev = spark.createDataFrame([("c", n, "A", -0.5 if i < 6 else 1.0, 1.5 + i) for i, n in enumerate(names)] + [("d", "p0", "A", 1.0, 2.0)], "case_id string, parameter string, grade string, low double, high double")
    text = " + ".join(f"p{i} * p{(i + 1) % 40}" for i in range(40))
    got = {r.case_id: r for r in bounds(ev, "case_id", text, names)["rungs"].where("rung = 'A'").collect()}
    x = Expression(text, names, {})
    top = sum((1.5 + i) * (1.5 + (i + 1) % 40) for i in range(40))
    assert got["c"].high == pytest.approx(top) and got["c"].low <= x.values(np.array([[-0.5] * 6 + [1.0] * 34]))[0]
    assert got["d"].low is None and got["d"].missing == 39


def test_what_cannot_be_read_is_refused():
    for text in ("a ** 2", "a + z", "open(a)", "a +", "a.b", "a if b else c"):
        with pytest.raises(ValueError):
            Expression(text, NAMES, {})


def test_corners_without_a_value_are_passed_over(spark):
    ev = spark.createDataFrame([("c", "a", "A", -1.0, 4.0), ("c", "b", "A", 0.0, 2.0), ("e", "a", "A", -3.0, -1.0), ("e", "b", "A", 0.0, 0.0)], "case_id string, parameter string, grade string, low double, high double")
    got = {r.case_id: (r.low, r.high) for r in bounds(ev, "case_id", "sqrt(a) / b", ["a", "b"])["rungs"].where("rung = 'A'").collect()}
    assert got == {"c": (1.0, 1.0), "e": (None, None)}
