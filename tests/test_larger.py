"""Cases that only larger tables or keys show."""

import re

import duckdb
import numpy as np
import pytest

from tallyspark.operators import audit as A
from tallyspark.operators import choice, order_stats
from tallyspark.plans.catalog import load


def _against_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    named, sql = load()
    got = named[name](spark, str(folder))
    cur = con.execute(sql[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


def test_numbers_that_grow_out_of_their_kind(spark, tmp_path):
    keys = spark.range(9_400, 9_700).unionByName(spark.range(19_000, 19_400)).unionByName(spark.range(11_365_000, 11_365_200)).unionByName(spark.range(125_000_000, 125_000_100))
    _against_sql(spark, "personal_data_scan", tmp_path, {"customer": keys.selectExpr("id as c_custkey", "concat('Customer#', lpad(id, 9, '0')) as c_name")})


def test_codes_with_a_common_first_token(spark):
    cells = ["EP-1", "(EP-2)", "EP-33x", "EP 4", "xEP-5", "a EP-6.1 b", "-7", "a-7", "--8", "a --8", "a--8", "9..", "9..b", "9.. b", "EP--10", "11-EP-12-13", "é-14", "15-é", "-16-", "a-16-", "--16-"]
    codes = [f"EP-{i}" for i in range(1, 14)] + ["EP-6.1", "-7", "--8", "9..", "EP--10", "EP-12", "11-EP", "é-14", "15-é", "-16-", "--", "7", "EP"]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    want = {c for c in codes if re.search("[A-Za-z0-9]", c) and len(c) >= 2 for t in [*cells, "x"] if re.search("(?<![A-Za-z0-9])" + re.escape(c) + "(?![A-Za-z0-9])", t)}
    assert {r.code for r in A.leaked_codes({"t": frame(cells, "x")}, frame(codes, "episode")).collect()} == want


def test_codes_are_not_paired_by_their_first_token(spark):
    n = 60_000
    t = spark.range(n).selectExpr("case when id % 1000 = 0 then concat('(EP-', id, ')') else concat('EP ', id) end as x")
    codes = spark.range(n).selectExpr("concat('EP-', id) as episode")
    assert A.leaked_codes({"t": t}, codes).count() == n // 1000


def test_listed_names_meet_texts_at_all_their_words(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    names = [f"{a} {b}" for a in words for b in words if a != b] + ["w1 w2 w3", "W1-W2", "w0 w1 w0", ".w5", "w39", "Ivan İpek"]
    texts = [" ".join(words[(i * 7 + j * j) % 40] for j in range(30)) for i in range(30)] + ["w1 w2 w3, w1-w2", "w0 w1 w0 w1 w0", "a.w5 w39w39 w39", "IVAN İPEK", "see https://w1 w2/w1 w2"]
    units = spark.createDataFrame([(str(i), "1", t) for i, t in enumerate(texts)], "file string, location string, text string")
    written, write = {}, A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    got = {r.file: r["count"] for r in A.name_counts(units, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    clean = [re.sub(r"https?://\S+", " ", t) for t in texts]
    want = {str(i): sum(len(re.findall(rf"(?i)(?<!\w){re.escape(n)}(?!\w)", t)) for n in names) for i, t in enumerate(clean)}
    assert got == {k: v for k, v in want.items() if v}
    # a text meets the names whose words it holds in a row, not every name with one of its words
    assert written["listed_pairs"].count() <= 35 * len(texts)


def _choices(spark, respondents, sets):
    rows = [(str(r), t, i, "abc"[(r * 3 + t * 5 + i * i) % 3], int(i == (r + t) % 4)) for r in range(respondents) for t in range(sets if r else 10 * sets) for i in range(3)]
    return spark.createDataFrame(rows, "respondent string, task int, profile int, attr string, chosen int")


def test_equal_choice_sets_are_fitted_once(spark, monkeypatch):
    c = choice.prepare_choice(_choices(spark, 30, 8), "attr", "chosen", "respondent", "task")
    kinds = choice.equal_sets(c.data, c.columns)
    sets = c.data.select("set_id").distinct().count()
    assert kinds.select("set_id").distinct().count() < sets / 5 and kinds.select("set_id", "w").distinct().agg({"w": "sum"}).first()[0] == sets
    fit = choice.fit_mnl(c)
    monkeypatch.setattr(choice, "equal_sets", lambda d, _: d)
    plain = choice.fit_mnl(c)
    assert np.allclose(fit.theta, plain.theta, atol=1e-9) and np.isclose(fit.loglik, plain.loglik)


def test_a_long_respondent_is_added_up_in_parts(spark, monkeypatch):
    df = _choices(spark, 12, 6)
    fit = lambda: choice.mixed_logit(df, "attr", "chosen", "respondent", "outside", draws=16, max_iter=4)["model"].first().loglik
    whole = fit()
    monkeypatch.setattr(choice, "PANEL_ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        assert np.isclose(fit(), whole, rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_groups_are_numbered_in_ranges(spark, monkeypatch):
    d = spark.range(3000).selectExpr("case when id % 3 = 0 then null else id % 50 * (id % 2) end as k", "id * 7919 % 3001 as v")
    got = lambda: sorted((str(r.k), r.v, r.n) for r in order_stats.row_numbers(d, ["k"], ["v"], "n").collect())
    plan = order_stats.row_numbers(d, ["k"], ["v"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "REPARTITION" not in plan and plan.count("Scan parquet") == 0  # small groups: one shuffle, nothing written
    plain = got()
    monkeypatch.setattr(order_stats, "BUCKET_ROWS", 100)
    assert got() == plain


def test_entries_are_screened_without_their_episodes(spark, monkeypatch):
    written = []
    monkeypatch.setattr("tallyspark.operators.screening.materialize", lambda df, name="stage": written.append(name) or df)
    queries, sql = load()
    got = sorted(map(tuple, queries["gates_entries"](spark, "/root/testdata/sf0.001").collect()))
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    assert got == sorted(con.execute(sql["gates_entries"]).fetchall()) and not written


def test_units_are_compared_without_a_join(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "k string") for rows in (["A ", "b", "b", None, "d"], ["a", "C", None, "c", "D"]))
    got = A.units_in_one_only(a, b, "k")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("b", "first"), (None, "first"), ("c", "second"), (None, "second")], "unit string, only_in string").collect()))


@pytest.mark.parametrize("patterns", [64, 0])
def test_a_mixed_logit_works_out_a_kind_of_sets_once(spark, monkeypatch, patterns):
    monkeypatch.setattr(choice, "PATTERNS", patterns, raising=False)
    df = _choices(spark, 40, 6)
    c = choice.prepare_choice(df, "attr", "chosen", "respondent", "task")
    panel = choice.panel_kinds(c).collect()
    assert len({r.kind for r in panel}) < sum(r.n for r in panel) / 5 and sum(r.n for r in panel) == c.data.select("set_id").distinct().count()
    fit = choice.mixed_logit(df, "attr", "chosen", "respondent", "outside", draws=16, max_iter=3)
    z = choice.halton_normal(16, 1, 20260928)
    # the likelihood at the fitted point, row by row
    b = {r.term: r for r in fit["coefficients"].collect()}
    pdf = c.data.toPandas()
    mean, sd = np.array([b[t].mean for t in c.terms]), b["outside"].random_sd
    total = 0.0
    for _, person in pdf.groupby("respondent"):
        lp = np.zeros(16)
        for _, one in person.groupby("set_id"):
            x = one[c.columns].to_numpy()
            u = (x @ mean)[:, None] + x[:, [c.terms.index("outside")]] * sd * z[:, 0]
            lp += u[one["y"].to_numpy() == 1].sum(0) - np.log(np.exp(u).sum(0))
        total += np.log(np.exp(lp).mean())
    got = fit["model"].first()
    assert not got.converged and np.isclose(got.loglik, total, rtol=1e-9)
