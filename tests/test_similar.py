"""Similarity joins against all pairs."""

import random

import duckdb
import pandas as pd
import pytest

from tallyspark.operators.audit import match_references
from tallyspark.operators.similar import RunPlan, similar_pairs


def _edited(rng, text, most):
    s = list(text)
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b", " "])
    return "".join(s)


@pytest.mark.parametrize("floor", [0.8, 0.85, 1.0])
def test_no_pair_is_lost(spark, floor):
    rng = random.Random(8)
    known = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["", None] + ["annual report of the office " * 3] * 3
    asked = [_edited(rng, t, int(len(t) * (1.1 - floor)) + 1) for t in known if t] + ["", None, "annual report of an office " * 3]
    con = duckdb.connect()
    con.register("x", pd.DataFrame({"a": asked}))
    con.register("y", pd.DataFrame({"b": known}))
    want = con.sql(f"SELECT DISTINCT a, b FROM x, y WHERE a <> '' AND b <> '' AND 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= {floor}").fetchall()
    got = similar_pairs(spark.createDataFrame([(t,) for t in asked], "a string"), spark.createDataFrame([(t,) for t in known], "b string"), floor)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)


def test_enough_runs_have_room_and_keys_stay_few():
    for floor in (0.6, 0.75, 0.85, 0.95, 1.0):
        plan = RunPlan(floor)
        assert all(plan._length(n) * (plan.edits(n) + 1) <= n for n in range(1, 3_000))


def test_a_long_title_gives_few_keys(spark):
    title = " ".join(f"word{i}" for i in range(300))
    got = similar_pairs(spark.createDataFrame([(title.replace("word7", "wrod7"),)], "a string"), spark.createDataFrame([(title,)], "b string")).collect()
    assert len(got) == 1 and got[0].ratio > 0.95


def test_several_misspelt_words_and_weak_matches(spark):
    registry = spark.createDataFrame([("10.1/a", "Constraint delays in the supply of spare parts for rolling stock", "2001", "Smith", "J")], "doi string, title string, year string, first_author string, journal string")
    asked = [("three", "Constraint delys in the suply of spar parts for rolling stock"), ("five", "Constrant delys in the suply of spar parts for roling stock"), ("weak", "Constraint delays in supply of the spare part of a rolling stock"), ("none", "Something else altogether")]
    supplied = spark.createDataFrame([(r, "", t, "2001", "Smith, A.", "J") for r, t in asked], "ref string, doi string, title string, year string, authors string, journal string")
    assert {r.ref: r.status for r in match_references(supplied, registry).collect()} == {"three": "MATCH_FOUND", "five": "MATCH_FOUND", "weak": "NOT_FOUND", "none": "NOT_FOUND"}
    assert {r.ref: r.status for r in match_references(supplied, registry, floor=0.75).collect()}["weak"] == "WEAK_MATCH"


def test_exploded_runs_are_not_broadcast_and_common_ones_are_spread(spark, monkeypatch):
    from tallyspark.operators import similar

    plans = {}
    write = similar.materialize

    def record(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(similar, "materialize", record)
    monkeypatch.setattr(similar, "COMMON_RUN", 5, raising=False)
    known = [f"annual report of the office number {i:04d} and {i * 7919 % 10007:05d}" for i in range(60)]
    asked = [t.replace("report", "reprt") for t in known]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.a, r.b) for r in similar.similar_pairs(frame(asked, "a"), frame(known, "b")).collect()}
    con = duckdb.connect()
    con.register("x", pd.DataFrame({"a": asked}))
    con.register("y", pd.DataFrame({"b": known}))
    assert got == set(con.sql("SELECT a, b FROM x, y WHERE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.85").fetchall())
    joins = [line for line in plans["met"].splitlines() if "Join [run" in line and "share" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("floor", [0.6, 0.75, 0.92])
def test_titles_of_one_template_in_rounds(spark, monkeypatch, floor):
    from tallyspark.operators import similar

    rng = random.Random(11)
    known = ["old plate large no%d %s" % (i, "".join(rng.choice("0123456789abcdefé\U0001f600") for _ in range(24))) for i in range(120)] + ["x", "xy", "ab ab"]
    asked = [_edited(rng, t, int(len(t) * (1.05 - floor)) + 1) for t in known] + known[:20]
    if floor == 0.75:
        monkeypatch.setattr(similar, "EXACT_CELLS", 0, raising=False)
    runs, write = [], similar.materialize
    monkeypatch.setattr(similar, "ROUND_LETTERS", 4_000, raising=False)
    monkeypatch.setattr(similar, "materialize", lambda df, name: runs.append(name) or write(df, name))
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    got = {(r.a, r.b) for r in similar.similar_pairs(frame(asked, "a"), frame(known, "b"), floor).collect()}
    want = {(a, b) for a in asked for b in known if a and 1 - _distance(a, b) / max(len(a), len(b)) >= floor}
    assert got == want and runs.count("met") >= 3


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_shuffles_of_a_written_table_are_deleted(spark):
    import time

    from tallyspark.runtime import materialize

    files = lambda: sum(f.getName().startswith("shuffle_") for f in _java_list(spark, spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    assert materialize(spark.range(100_000).selectExpr("id % 1000 as k").groupBy("k").count(), "counts").count() == 1000
    end = time.time() + 20
    while files() > before + 4 and time.time() < end:  # those of the count remain
        time.sleep(0.2)
    assert files() <= before + 4


def _java_list(spark, seq):
    return list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))
