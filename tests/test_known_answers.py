"""Small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.dates import days_problem, parse_days
from tallyspark.operators import agreement as A
from tallyspark.operators import audit, bounds, hypothesis
from tallyspark.operators.coding import process_trace
from tallyspark.registry import analysis, catalog, run, run_steps


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_distribution_functions():
    assert dist.t_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-8)
    assert dist.t_ppf([0.975], [10.0])[0] == pytest.approx(2.22813885, abs=1e-7)
    assert dist.f_sf([3.0], [2.0], [20.0])[0] == pytest.approx(0.0725382, abs=1e-6)
    assert dist.chi2_sf([3.841458820694124], [1.0])[0] == pytest.approx(0.05, abs=1e-10)
    assert dist.norm_ppf([0.975])[0] == pytest.approx(1.959963985, abs=1e-8)
    assert dist.studentized_range_ppf(0.95, 3, 20) == pytest.approx(3.577935, abs=1e-5)


def test_kappa_and_ac1(spark):
    d = spark.createDataFrame(list(zip("YYYNN", "YYNNY")), "a string, b string")
    assert rows(A.agreement(d, "a", "b")["statistics"])[0]["kappa"] == pytest.approx(1 / 6)
    same = spark.createDataFrame([("Y", "Y")] * 5, "a string, b string")
    assert rows(A.agreement(same, "a", "b", categories="Y,N,U")["statistics"])[0]["ac1"] == pytest.approx(1.0)


def evidence(spark, extra=()):
    base = [("o_I", "B", 0.0, 14.75), ("rho", "A", 0.0, 0.09473), ("p_S", "B", 9.2773, 16.8924), ("F_S", "D", 8988.0, 64800.0), *extra]
    return spark.createDataFrame([("c", *r) for r in base], "case_id string, parameter string, grade string, low double, high double")


def test_published_bounds_and_breakdown(spark):
    r = bounds.bounds(evidence(spark), "case_id", "o_I - rho*p_S + (F_I - F_S)/Q", ["o_I", "rho", "p_S", "F_S"], fixed={"Q": 500, "F_I": 0}, label_below="favoured", breakdown_parameter="o_I")
    got = {x["rung"]: x for x in rows(r["rungs"])}
    assert got["C"]["status"] == "NOT IDENTIFIED"
    assert round(got["I"]["low"], 2) == -131.20 and round(got["I"]["high"], 2) == -3.23 and got["I"]["status"] == "favoured"
    assert rows(r["breakdown"])[0]["value"] == pytest.approx(17.976, abs=1e-6)


def test_conflicting_evidence_is_not_admitted(spark):
    r = bounds.bounds(evidence(spark, [("o_I", "S", 20.0, 30.0)]), "case_id", "o_I - rho*p_S + (F_I - F_S)/Q", ["o_I", "rho", "p_S", "F_S"], fixed={"Q": 500, "F_I": 0})
    c = rows(r["conflicts"])
    assert len(c) == 1 and (c[0]["kept_low"], c[0]["kept_high"]) == (0.0, 14.75)


def test_formula_rejects_unknown_names_and_functions():
    for text in ("a + b", "system(a)", "a; drop", "__import__(a)"):
        with pytest.raises(ValueError):
            bounds.formula(text, ["a"])


def test_latency_example(spark):
    routes = spark.createDataFrame([("R1", "completed", 30.0, None, None), ("R2", "completed", 30.0, None, None), ("R3", "completed", 20.0, 30.0, None), ("R4", "pending", 30.0, None, 42.0),
                                    ("R5", "screened_out", 30.0, None, None), ("R6", "refused", 30.0, None, None), ("R7", "not_attempted", 30.0, None, None)],
                                   "route string, status string, window_low double, window_high double, elapsed double")
    stages = spark.createDataFrame([("R1", "approval", "S", 7.0, 14.0), ("R1", "approval", "A", 5.0, 21.0), ("R1", "conditions", "S", 0.0, 7.0), ("R1", "disbursement", "I", 1.0, 3.0),
                                    ("R2", "approval", "S", 14.0, 28.0), ("R2", "conditions", "S", 7.0, 14.0), ("R2", "disbursement", "S", 1.0, 5.0)], "route string, stage string, grade string, low double, high double")
    totals = spark.createDataFrame([("R3", "S", 2.0, 10.0), ("R3", "I", 3.0, 5.0), ("R4", "S", 21.0, 35.0), ("R5", "S", 30.4375, 91.3125)], "route string, grade string, low double, high double")
    r = bounds.latency_bounds(routes, stages, totals)
    got = {x["route"]: x for x in rows(r["routes"])}
    assert [got[f"R{i}"]["label"] for i in range(1, 8)] == ["surely on time", "undetermined", "surely on time", "surely late", "surely late", "not usable", "not identified"]
    assert (got["R1"]["low"], got["R1"]["high"]) == (8.0, 24.0)
    s = rows(r["share"])[0]
    assert s["lower"] == pytest.approx(2 / 7) and s["upper"] == pytest.approx(4 / 7)
    assert r["conflicts"].count() == 1


@pytest.mark.parametrize("text,days", [("2026-02-03", 20487.0), ("2026-02-03 12:00", 20487.5), ("2026-02-03 12:00+02:00", 20487.4166666), ("2026-02-03T12:00:00Z", 20487.5), ("03.02.2026", 20487.0), ("2026. 02. 03.", 20487.0),
                                        ("45000", 19431.0), ("", None), ("02/03/2026", None), ("31.02.2026", None), ("soon", None), ("123", None)])
def test_parse_days(spark, text, days):
    r = rows(spark.createDataFrame([(text,)], "x string").select(parse_days("x").alias("d"), days_problem("x").alias("p")))[0]
    assert r["d"] == (pytest.approx(days, abs=1e-6) if days is not None else None)
    assert (r["p"] is None) == (days is not None or text == "")


POSITIVE = [("ali@example.com", "e-mail address"), ("+36 30 123 4567", "phone number"), ("GB82 WEST 1234 5698 7654 32", "bank account (IBAN)"), ("10000000146", "Turkish ID number (TCKN)"), ("4111 1111 1111 1111", "payment card number")]
CLEAN = ["EP-D01", "Company A", "2026-02-03", "12345.67", "Yes", "GB82 WEST 1234 5698 7654 33", "10000000147", "4111 1111 1111 1112", "123456", "", "note 4"]


@pytest.mark.parametrize("value,kind", POSITIVE)
def test_cell_kinds_found(spark, value, kind):
    got = rows(audit.personal_data_scan(spark.createDataFrame([(value,)], "cell string")))
    assert kind in {g["kind"] for g in got}


def test_clean_cells_stay_clean(spark):
    assert rows(audit.personal_data_scan(spark.createDataFrame([(v,) for v in CLEAN], "cell string"))) == []


def test_text_units(spark):
    u = spark.createDataFrame([("a", "l1", "write to ali@example.com or call +36 30 123 4567"), ("a", "l2", "see https://x.org/12345678901 and EUR 1,250.00"), ("b", "l1", "Customer: Anna Kovács"), ("c", "l1", "nothing here"), ("d", "l1", "  ")],
                              "file string, location string, text string")
    r = audit.text_audit(u, [{"pattern": "nothing", "issue": "vague"}])
    found = {(x["file"], x["finding"]): x["count"] for x in rows(r["findings"])}
    assert found[("a", "e-mail address")] == 1 and found[("a", "phone number")] == 1 and found[("a", "exact amount")] == 1 and found[("b", "person name (labelled field)")] == 1
    assert {x["file"]: x["status"] for x in rows(r["summary"])} == {"a": "personal data", "b": "personal data", "c": "wording to update", "d": "unreadable"}


def test_fisher_matches_enumeration(spark):
    data = [("x", "p")] * 8 + [("x", "q")] * 2 + [("y", "p")] * 1 + [("y", "q")] * 5
    p = rows(hypothesis.fisher_exact(spark.createDataFrame(data, "r string, c string"), "r", "c", block=3))[0]["p"]
    pr = lambda a: math.comb(10, a) * math.comb(6, 9 - a) / math.comb(16, 9)
    assert p == pytest.approx(sum(pr(a) for a in range(3, 10) if pr(a) <= pr(8) * (1 + 1e-7)), abs=1e-9)


def test_unknown_process_tracing_test_stops(spark):
    d = spark.createDataFrame([("c", "p", "hunch", "pass", "s")], "a string, b string, t string, r string, s string")
    with pytest.raises(Exception, match="unknown test type"):
        process_trace(d, "a", "b", "t", "r", "s")["register"].collect()


def test_registry_and_steps(spark):
    @analysis("row_count_demo")
    def row_count_demo(df):
        return df.agg(F.count(F.lit(1)).alias("n"))

    d = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "b")], "x double, g string")
    assert rows(run("row_count_demo", d)["row_count_demo"]) == [{"n": 3}]
    out = run_steps(d, '[{"analysis": "frequencies", "params": {"variables": "g"}}, {"analysis": "t_one_sample", "params": {"variables": "x", "mu": 1.0}}]')
    assert len(out) == 2 and rows(out[1]["t_one_sample"])[0]["mean"] == pytest.approx(1.5)
    assert len(catalog()) > 40
    with pytest.raises(KeyError):
        run("no such analysis", d)
