"""Cases that once went wrong: null keys, other scripts, several changed words, large boxes, rows without an id."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.columns import text_levels
from tallyspark.operators import audit as A
from tallyspark.operators import quality as Q
from tallyspark.operators.bounds import bounds
from tallyspark.operators.choice import _choice_sums, halton_normal
from tallyspark.operators.network import blind_packet
from tallyspark.operators.order_stats import row_numbers
from tallyspark.operators.sets import fsqca


def test_rows_with_a_null_key_are_numbered(spark):
    d = spark.createDataFrame([(None, 2), (None, 1), (1, 5)], "k int, v int")
    assert sorted((str(r.k), r.v, r.n) for r in row_numbers(d, ["k"], ["v"], "n").collect()) == [("1", 5, 1), ("None", 1, 1), ("None", 2, 2)]


def _kinds(spark, text, **how):
    row = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in A.text_kinds(F.col("t"), **how).items()]).first()
    return {k: v for k, v in row.asDict().items() if v}


def test_text_patterns_know_other_scripts(spark):
    assert _kinds(spark, "costs 12 500 Ft today") == {"amount": 1}
    assert _kinds(spark, "costs ١٢٣٤٥ EUR today") == {"amount": 1}
    assert _kinds(spark, "call +36 30 123 4567 now").get("phone", 0) == 0 and _kinds(spark, "call +36 30 123 4567 now") == {"phone": 1}
    assert _kinds(spark, "Žana came", names=["Ana"]) == {} and _kinds(spark, "Ana came", names=["Ana"]) == {"listed": 1}


def test_white_space_of_any_kind_is_blank(spark):
    units = spark.createDataFrame([("a", "1", "\t  "), ("b", "1", "plain words")], "file string, location string, text string")
    assert {r.file: r.status for r in A.text_audit(units)["summary"].collect()} == {"a": "unreadable", "b": "clean"}
    cells = spark.createDataFrame([("\t+36 30 123 4567",), ("\t",)], "x string")
    assert [(r.kind, r["count"]) for r in A.personal_data_scan(cells).collect()] == [("phone number", 1)]


def test_wording_is_reported_whole(spark):
    units = spark.createDataFrame([("a", "1", "old " + "very " * 40 + "term")], "file string, location string, text string")
    hit = A.text_audit(units, rules=[{"pattern": "old (very )+term", "issue": "x"}])["findings"].where("matched <> ''").first()
    assert len(hit.matched) == len("old " + "very " * 40 + "term")


@pytest.mark.parametrize("asked", ["constraint delays in the supply of spare parts", "constraints delay in the suply of spare part"])
def test_titles_that_differ_in_two_words_are_found(spark, asked):
    registry = spark.createDataFrame([("", "Constraints delay in the supply of spare parts", "2001", "Smith", "J")], "doi string, title string, year string, first_author string, journal string")
    supplied = spark.createDataFrame([("r", "", asked, "2001", "Smith, A.", "J")], "ref string, doi string, title string, year string, authors string, journal string")
    assert A.match_references(supplied, registry).first().status == "MATCH_FOUND"


def test_sixteen_uncertain_parameters(spark):
    names = [f"p{i}" for i in range(16)]
    ev = spark.createDataFrame([("c", n, "A", -1.0, float(i)) for i, n in enumerate(names)], "case_id string, parameter string, grade string, low double, high double")
    r = bounds(ev, "case_id", " - ".join(names), names)["rungs"].where("missing = 0").first()
    assert (r.low, r.high) == (-1.0 - sum(range(1, 16)), 0.0 + 15)


def test_truth_table_of_six_conditions(spark):
    rows = [tuple((i >> j & 1) * 0.8 + 0.1 for j in range(6)) + (0.9 if i % 3 == 0 else 0.2,) for i in range(64)]
    cols = [f"c{j}" for j in range(6)]
    t = fsqca(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "y"])), cols, "y")["truth_table"].collect()
    assert len(t) == 64 and {r.cases for r in t} == {1}
    for r in t[:5]:
        member = [min(x if b else 1 - x for x, b in zip(row, (r[c] for c in cols))) for row in rows]
        assert r.consistency == pytest.approx(sum(min(m, row[6]) for m, row in zip(member, rows)) / sum(member))


def test_levels_have_no_hidden_limit(spark):
    assert len(text_levels(spark.range(3000), "id")) == 3000
    with pytest.raises(ValueError):
        text_levels(spark.range(30), "id", 10)


def test_large_utilities_do_not_overflow(spark):
    d = spark.createDataFrame([(1, 1.0, 2000.0), (1, 0.0, 1990.0)], "set_id int, y double, x0 double")
    ll, _, _ = _choice_sums(d, F.col("x0"), [F.col("x0")])
    assert ll == pytest.approx(-4.54e-5, rel=1e-2)


def test_draws_of_many_dimensions_are_filled():
    z = halton_normal(4, 400, 1)
    assert z.shape == (4, 400) and abs(z).max() < 10


def test_rows_without_an_id_stay_in_the_packet(spark):
    t = spark.createDataFrame([("a", 1), (None, 2), (" ", 3)], "episode string, value int")
    out = blind_packet({"t": t}, "episode", 5)["t"].collect()
    assert sorted(r.value for r in out) == [1, 2, 3] and sum(r.episode is None for r in out) == 2


def test_offending_units_are_listed_and_counted_once(spark):
    d = spark.createDataFrame([("e1", "x"), ("e1", "x"), ("e2", "a")], "unit_id string, v string")
    checks = [Q.check_allowed(d, "v", ["a"], "t", "unit_id"), Q.check_condition(d, F.col("v") == "zz", "none", "t", "unit_id")]
    assert sorted((r["level"], r["check"], r.n) for r in Q.integrity(checks).collect()) == [("FAIL", "v outside the list", 1), ("PASS", "none", 0)]
    assert [(r["check"], r.unit) for r in Q.offenders(checks).collect()] == [("v outside the list", "e1")]


def test_verdicts_say_what_could_not_be_tested(spark):
    from tallyspark.operators.network import verdicts

    ep = spark.createDataFrame([("E1", "2024-01-01", "2024-01-20", "B")], "episode string, anchor_earliest string, tw_earliest string, r_step string")
    st = spark.createDataFrame([("E1", "A", "finance", "", "2024-02-01", "5"), ("E1", "P", "payment", "", "2024-01-02", None), ("E1", "B", "logistics", "A;P", "2024-01-25", "1")], "episode string, step string, clock string, predecessors string, finish_earliest string, expected_days string")
    r = verdicts(ep, st)
    row = r["verdicts"].first()
    assert "clocks without an ex-ante duration could not be tested: payment" in row.flags or row.verdict == "Indeterminate"
    assert "1 steps finish before they are ready at the earliest bound" in row.flags
    assert sorted((x.step, x.bound) for x in r["floored_steps"].collect()) == [("B", "earliest"), ("B", "latest")]


def test_listed_names_are_counted_as_one_pattern_a_name_would(spark):
    import re

    texts = ["Anna Kiss met ANNA KISS, not Anna Kissné.", "O'Brien (obrien) and x.y z", "İnci saw inci; Σοφός, ΣΟΦΟΣ", "nothing here", "", None, "a.b.a.b a.b", "Kiss, Kiss", "see https://x.org/Kiss and Kiss"]
    names = ["Anna Kiss", "Kiss", "O'Brien", "x.y z", "inci", "σοφός", "a.b", "ab", None, "absent word", "Kiss", "...", r"q\E"]
    units = spark.createDataFrame([(str(i), "l", t) for i, t in enumerate(texts)] + [("0", "l", texts[0])], "file string, location string, text string")
    got = sorted((r.file, r["count"]) for r in A.name_counts(units.where("text <> ''"), spark.createDataFrame([(n,) for n in names], "name string")).collect())
    usable = sorted({n for n in names if n and len(n) >= 3 and re.search(r"\w", n)})
    slow = units.where("text <> ''").select("file", A.text_kinds(F.col("text"), usable)["listed"].alias("n")).where("n > 0")
    assert got == sorted((r.file, r.n) for r in slow.collect()) and ("0", 4) in got
    assert A.name_counts(units.limit(0), spark.createDataFrame([("Kiss",)], "name string")).count() == 0


def test_many_listed_names(spark):
    names = spark.range(100_000).selectExpr("concat('Person ', id) AS name")
    units = spark.createDataFrame([("f", "l", f"text with person {i}, and more") for i in range(0, 200_000, 1000)], "file string, location string, text string")
    found = A.text_audit(units, names=names)["findings"].where("finding = 'listed name'")
    assert found.agg(F.sum("count")).first()[0] == 100
