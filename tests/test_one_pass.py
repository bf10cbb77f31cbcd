"""Work that is done once: plans that do not repeat a step, with results that stay the same."""

from pyspark.sql import functions as F

from tallyspark.operators import audit as A


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_audit_cleans_and_scans_every_unit_once(spark):
    rows = [("a", "line 1", "mail x@y.org, isBN 123456789X, call +36 30 1234567"), ("a", "appendix", "old term"), ("b", "line 1", "an old term\tand old terms"), ("b", None, "old term"), ("b", "line 2", "  \t"), ("c", "line 1", "Name: Anna Kiss"),
            ("c", "line 2", "ΣΟΦΟΣ'Α ΚΙΣΣ and anna  kiss"), ("c", "line 3", "see Anna Kiss, ANNA KISS"), ("d", "line 1", None)]
    units = spark.createDataFrame(rows, "file string, location string, text string")
    rules = [{"pattern": r"\bold\s+terms?\b", "issue": "wording"}]
    plan = optimized(A.text_audit(units, rules)["findings"])
    assert plan.count("ISBN") == 1 and plan.count("Generate inline") == 1
    r = A.text_audit(units, rules, names=["Anna Kiss", "ΣΟΦΟΣ"], exempt_locations=["append"])
    got = sorted((x.file, x.location or "", x.finding, x["count"], x.matched) for x in r["findings"].collect())
    assert got == [("a", "line 1", "e-mail address", 1, ""), ("a", "line 1", "phone number", 1, ""), ("b", "line 1", "wording", 1, "old term"), ("b", "line 1", "wording", 1, "old terms"),
                   ("c", "line 1", "listed name", 1, ""), ("c", "line 1", "person name (labelled field)", 1, ""), ("c", "line 2", "listed name", 1, ""), ("c", "line 3", "listed name", 2, "")]
    assert {x.file: (x.units, x.status) for x in r["summary"].collect()} == {"a": (2, "personal data"), "b": (2, "wording to update"), "c": (3, "personal data"), "d": (0, "unreadable")}


def test_few_listed_names_give_what_many_give(spark, monkeypatch):
    texts = ["Anna Kiss met ANNA KISS", "İnci saw inci; Σοφός, ΣΟΦΟΣ, ΣΟΦΟΣ'Α", "nothing", "a.b.a.b", "x y-z Y-Z"]
    units = spark.createDataFrame([(str(i), "l", t) for i, t in enumerate(texts)], "file string, location string, text string")
    names = spark.createDataFrame([(n,) for n in ("anna kiss", "inci", "σοφός", "a.b", "y-z")], "name string")
    got = lambda: sorted((r.file, r["count"]) for r in A.name_counts(units, names).collect())
    few = got()
    monkeypatch.setattr(A, "FEW_NAMES", 0)
    assert few == got() and len(few) == 4


def test_spearman_repeats_no_row_for_the_pairs(spark, monkeypatch):
    from itertools import combinations

    import numpy as np

    from tallyspark.operators import correlate, order_stats

    def rank(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    rows = [(i, None if i % 7 == 0 else float(i * 37 % 11), None if i % 5 == 2 else -float(i % 4), float("nan") if i % 3 == 0 else float(i * 13 % 50) / 3, None) for i in range(300)]
    d = spark.createDataFrame(rows, "k int, a double, b double, c double, gone double")
    got = {(r.first, r.second): (r.r, r.n) for r in correlate.correlation(d, ["a", "b", "c", "gone"], "spearman").collect()}
    want = {}
    for (i, x), (j, y) in combinations(enumerate("abc", 1), 2):
        both = [(r[i], r[j]) for r in rows if all(v is not None and v == v for v in (r[i], r[j]))]
        want[x, y] = (np.corrcoef(*[rank(v) for v in zip(*both)])[0, 1], len(both))
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 1e-12 and got[p][1] == want[p][1] for p in want)
    same = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, None)], "x double, y double, z double")
    assert sorted((r.first, r.second, r.r, r.n) for r in correlate.spearman(same, ["x", "y", "z"]).collect()) == [("x", "y", None, 2), ("x", "z", None, 1), ("y", "z", None, 1)]
    written = []
    for module in (correlate, order_stats):
        monkeypatch.setattr(module, "materialize", lambda df, name, keep=module.materialize: written.append(keep(df, name)) or written[-1])
    correlate.spearman(spark.range(300).selectExpr("id * 1.0 AS a", "id * 2.0 AS b", "-id * 1.0 AS c", "id % 7 * 1.0 AS e"), ["a", "b", "c", "e"]).collect()
    assert written and max(t.count() for t in written) <= 4 * 300


def test_rungs_are_plain_columns_and_only_the_last_one_is_made_for_routes(spark):
    from tallyspark.operators import bounds

    ladder = bounds.LADDER
    rows = [(k, ladder[(k * 3 + i * (1 + k % 2)) % len(ladder)], float(k % 5 + i * 4 % 7), float(k % 5 + 3 + i % 3) if (k + i) % 6 else None) for k in range(60) for i in range(k % 8)]
    rows += [(99, ladder[0], None, None), (98, "other", 1.0, 2.0)]
    want = []
    for k in sorted({r[0] for r in rows if r[1] in ladder}):
        low = high = None
        for g in ladder:
            ends = [sorted(x for x in r[2:] if x is not None) for r in rows if r[0] == k and r[1] == g]
            a, b = min((e[0] for e in ends if e), default=None), max((e[-1] for e in ends if e), default=None)
            clash = None not in (low, a) and max(low, a) > min(high, b)
            if a is not None and not clash:
                low, high = (a, b) if low is None else (max(low, a), min(high, b))
            want.append((k, g, low, high, clash, a, b))
    got = bounds.admit_intervals(spark.createDataFrame(rows, "k int, grade string, low double, high double"), ["k"])
    assert [tuple(r) for r in got.collect()] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.columns == ["k", "rung", "low", "high", "conflict", "given_low", "given_high"]
    routes = spark.createDataFrame([(1, "completed", 60.0, None, None)], "route int, status string, window_low double, window_high double, elapsed double")
    stages = spark.createDataFrame([(1, "s", ladder[0], 1.0, 2.0)], "route int, stage string, grade string, low double, high double")
    plan = optimized(bounds.latency_bounds(routes, stages, stages.drop("stage"))["routes"])
    assert "Generate" not in plan and "lambda" not in plan


RULES = {"protocol_version": "1", "id_column": "id", "episode_column": "ep", "values": {"pass": ["Yes"], "fail": ["No"], "unknown": ["Open"]}, "levels": {"S0": "Low", "L1": "Mid", "L2": "High"}, "stages": [
    {"id": "S0", "name": "Entry", "unit": "entry", "criteria": [{"id": "a", "type": "in", "column": "kind", "allowed": ["good", "Fine"], "scale": ["good", "Fine", "bad"]}]},
    {"id": "L1", "name": "First", "unit": "episode", "criteria": [{"id": "b", "column": "x"}, {"id": "c", "column": "z", "gate": False}]},
    {"id": "L2", "name": "Second", "unit": "episode", "paths": [{"name": "p", "criteria": [{"id": "d", "column": "x"}, {"id": "e", "column": "y"}]}, {"name": "q", "criteria": [{"id": "f", "type": "min", "column": "n", "value": 2}, {"id": "e", "column": "y"}]}]}]}


def test_comparing_rule_sets_writes_nothing_and_joins_no_spellings(spark, monkeypatch):
    from tallyspark.operators import screening as G

    rows = [("1", "E1", "GOOD", "yes", "", "No", "3"), ("2", "e1", "good", "Yes ", "", "", " 3"), ("3", "E2", "bad", "Yes", "No", "", "1"), ("4", "E2", "fine", "Yes", "No", "Yes", "1.5"), ("5", "E3", "fine", "Yes", "", "Yes", "5"), ("6", "e3", "fine", "no", "", "No", "5"),
            ("7", "E4", "open", "Yes", "", "Yes", "9"), ("8", "E5", "good", "Yes", "odd", "Yes", "x"), ("9", "", "good", "Yes", "", "Yes", "2"), ("10", "E6", "good", "Yes", "", "Yes", "2.0")]
    d = spark.createDataFrame(rows, "id string, ep string, kind string, x string, z string, y string, n string")
    r = G.apply_gates(d, RULES)
    eps = {e.ep: e for e in r["episodes"].collect()}
    assert {k: (e.level, e.x, e.y, e.n, e.n_entries) for k, e in eps.items()} == {
        "E1": ("Mid", "Yes", "No", "3", 2), "E2": ("High", "Yes", "Yes", "1.5", 2), "E3": ("Low (pending evidence at L1)", "CONFLICT", "CONFLICT", "5", 2), "E4": ("Held at S0 (not yet analysable)", "Yes", "Yes", "9", 1),
        "E5": ("High", "Yes", "Yes", "", 1), "E6": ("High", "Yes", "Yes", "2.0", 1)}
    assert eps["E2"].L2_all_paths == "p: Pass || q: Fail fail[f]" and eps["E5"].L2_all_paths == "p: Pass || q: Hold held[f]" and eps["E2"].L2_path == "p" and eps["E1"].L2_failed == "e" and eps["E3"].L1_first_held == "b"
    said = {(p["where"], p.problem.split(" across")[0].split(", from")[0]) for p in r["problems"].collect()}
    assert ("E3", "conflicting values for 'x'") in said and ("E1", "episode id written in different forms, e.g. 'E1' and 'e1'; merged as 'E1'") in said and ("9", "entry is not excluded at the entry stage but has no episode id") in said
    assert sorted({e.ep for e in r["entries"].collect()}) == ["", "E1", "E2", "E3", "E4", "E5", "E6"] and {m.ep for m in r["episode_entries"].collect()} == set(eps)
    monkeypatch.setattr(G, "materialize", lambda *a: 1 / 0)
    other = {**RULES, "stages": RULES["stages"][:-1]}
    out = G.compare_gates(d, RULES, other)
    assert {(c.ep, c.first, c.second, c.changed) for c in out.collect()} == {
        ("E1", "Mid", "Mid", False), ("E2", "High", "Mid", True), ("E3", "Low (pending evidence at L1)", "Low (pending evidence at L1)", False),
        ("E4", "Held at S0 (not yet analysable)", "Held at S0 (not yet analysable)", False), ("E5", "High", "Mid", True), ("E6", "High", "Mid", True)}
    assert "lambda" not in optimized(out)


def test_consistency_rules_are_read_on_one_row_an_episode(spark):
    from tallyspark.operators import quality as Q

    ep = spark.createDataFrame([("E1", "Level 3", "A", "Rejected", "Yes", "No", ""), (" E2 ", "Level 2", "B", "", "Yes", "Yes", ""), ("E3", "Level 3", "", "odd", "No", "Yes", "x"), (None, "Level 3", "A", "Rejected", "Yes", "Yes", "x")],
                               "episode string, level string, recorded_verdict string, rival string, ok string, indep string, source string")
    v = spark.createDataFrame([("E1", "A", "Yes", "No"), ("E1", "B", "No", "No"), ("E2", "B", "No", "Not computable"), (None, "C", "No", "No")], "episode string, verdict string, fragile string, finance_actionable string")
    st = spark.createDataFrame([("E1", "Payment", "Finance", "0", "no"), ("E1", "other", "x", None, ""), ("E2", "Training", "finance", "0", "Yes"), ("", "Payment", "finance", None, ""), (None, "Payment", "finance", "0", "")],
                               "episode string, step string, clock string, expected_days string, zero_documented string")
    cand = spark.createDataFrame([("E1", "Retained"), ("E9", "Retained"), ("E8", ""), (None, "")], "candidate string, decision string")
    args = (cand, "episode", "ok", "indep", "source")
    r = Q.consistency_checks(ep, v, None, st, *args)
    want = {("Level-3 episode without a timeline", "E3"), ("Level-3 episode without a timeline", None), ("Timeline of an episode that is not Level 3", "E2"), ("Expected durations coded as documented but blank in the steps", "E1"),
            ("Expected duration of exactly 0 days", "E1"), ("Expected duration of exactly 0 days", "E2"), ("Recorded verdict differs from the computed one", "E1"), ("Level-3 episode with no verdict recorded", "E3"),
            ("Fragile verdict: decisive slack within one day of zero", "E1"), ("Duration 0 without zero_documented = Yes (treated as missing)", "E1"), ("Finance actionability not computable", "E2"), ("Level-3 episode without a valid rival result", "E3"),
            ("Payment-type step coded on the finance clock", "E1"), ("Readiness-type step not on the readiness clock", "E2"), ("Episode that is not retained in the candidate list", "E2"), ("Episode that is not retained in the candidate list", "E3"),
            ("Episode that is not retained in the candidate list", None), ("Retained candidate missing from the episodes", "E9"), ("Candidate without a decision", "E8"), ("Independence not met but source kind not coded", "E1")}
    rows = [(x.check, x.unit) for x in r["offenders"].collect()]
    assert set(rows) == want and len(rows) == len(want)
    n = {x.check: x.n for x in r["checks"].collect()}
    assert len(n) == 17 and sum(n.values()) == len(want) and n["Episode that is not retained in the candidate list"] == 3
    again = Q.consistency_checks(ep, v, st.select("episode"), st, *args)["offenders"]
    assert {(x.check, x.unit) for x in again.collect()} == want
    marked = st.withColumn("episode", F.concat("episode", F.lit("__steps__")))
    assert optimized(Q.consistency_checks(ep, v, None, marked, *args)["offenders"]).count("__steps__") <= 2
