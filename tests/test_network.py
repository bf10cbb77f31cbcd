"""Verdicts against a separately written per-episode computation on random networks."""

from itertools import combinations

import numpy as np
import pytest

from tallyspark.operators import network as N

CLOCKS = ["finance", "payment", "fulfilment", "logistics", "operational-readiness"]


def random_tables(seed, count):
    rng = np.random.default_rng(seed)
    eps, steps = [], []
    for k in range(count):
        n = int(rng.integers(1, 8))
        fin = np.cumsum(rng.integers(0, 9, size=n)).astype(float) + 30000
        for i in range(n):
            preds = [f"s{j}" for j in range(i) if rng.uniform() < 0.5]
            lo = float(fin[i])
            exp = None if rng.uniform() < 0.15 else float(rng.integers(1, 6))
            steps.append((f"e{k}", f"s{i}", str(rng.choice(CLOCKS)), ";".join(preds), str(lo), str(lo + float(rng.integers(0, 3))), None if exp is None else str(exp)))
        tw = float(fin[-1] - rng.integers(-3, 15))
        eps.append((f"e{k}", "29998", "29999", str(tw), str(tw + float(rng.integers(0, 3))), f"s{n - 1}"))
    return eps, steps


def brute(eps, steps):
    out = {}
    for e, a_lo, a_hi, t_lo, t_hi, goal in eps:
        st = {s[1]: s for s in steps if s[0] == e}
        order = list(st)
        anc, todo = set(), [goal]
        while todo:
            x = todo.pop()
            if x not in anc:
                anc.add(x)
                todo += [p for p in st[x][3].split(";") if p]
        res = []
        for b in (0, 1):
            anchor, tw = float((a_lo, a_hi)[b]), float((t_lo, t_hi)[b])
            f = {x: float(st[x][4 + b]) for x in order}
            pre = {x: [p for p in st[x][3].split(";") if p] for x in order}
            real = {x: max(0.0, f[x] - max([f[p] for p in pre[x]], default=anchor)) for x in order}
            exp = {x: None if st[x][6] is None else float(st[x][6]) for x in order}

            def slack(cs):
                done = {}
                for x in order:
                    d = min(real[x], exp[x]) if st[x][2] in cs and exp[x] is not None else real[x]
                    done[x] = max([done[p] for p in pre[x]], default=anchor) + d
                return tw - done[goal]

            clocks = sorted({st[x][2] for x in anc})
            free = [c for c in clocks if all(exp[x] is not None for x in anc if st[x][2] == c)]
            ok = lambda cs: slack(set(cs)) >= -1e-9
            single = [c for c in free if ok([c])]
            pairs = [p for p in combinations(free, 2) if ok(p)]
            if ok([]):
                r = ("Non-binding", ())
            elif single:
                r = (N.CLOCK_LABELS[single[0]] if len(single) == 1 else "Multiple sufficient corrections", tuple(single))
            elif len(free) < len(clocks):
                r = ("Indeterminate", ())
            elif pairs:
                r = ("Jointly binding", tuple(" + ".join(p) for p in pairs))
            elif len(free) > 2 and ok(free):
                r = ("Jointly binding", (" + ".join(free),))
            else:
                r = ("Window infeasible at ex-ante durations", ())
            res.append(r)
        out[e] = res[0][0] if res[0] == res[1] else "Indeterminate"
    return out


EP = "episode string, anchor_earliest string, anchor_latest string, tw_earliest string, tw_latest string, r_step string"
ST = "episode string, step string, clock string, predecessors string, finish_earliest string, finish_latest string, expected_days string"
COLS = ["episode", "engine_outcome", "verdict", "binding_clocks", "indeterminate_reason", "finance_slack_earliest", "finance_slack_latest", "decisive_slack_earliest", "finance_actionable"]


@pytest.fixture(scope="module")
def tables(spark):
    eps, steps = random_tables(11, 150)
    return eps, steps, spark.createDataFrame(eps, EP), spark.createDataFrame(steps, ST)


def test_verdicts_on_random_networks(tables):
    eps, steps, e, s = tables
    got = {r["episode"]: r["engine_outcome"] for r in N.verdicts(e, s, reactive=False)["verdicts"].collect()}
    assert got == brute(eps, steps)


def test_large_episode_rounds_give_the_same_rows(tables):
    _, _, e, s = tables
    labels, syn = N.clock_set()
    ep, st, problems, notes = N.read_episodes(e, s, labels, syn)
    rows = lambda limit: sorted(map(tuple, N.evaluate(ep, st, problems, notes, labels, reactive=False, block_steps=limit).select(*COLS).collect()))
    assert repr(rows(0)) == repr(rows(2000))


def test_halting_reasons(spark):
    day = lambda n: str(20000 + n)
    ep = spark.createDataFrame([(x, day(0), None, day(9), None, "b") for x in ("ok", "cycle", "lost", "nogoal", "undated", "empty", "badclock", "dupstep")], EP)
    st = []
    for x in ("ok", "cycle", "lost", "nogoal", "undated", "badclock", "dupstep"):
        st.append((x, "a", "funding" if x != "badclock" else "weather", "b" if x == "cycle" else "", day(3) if x != "undated" else None, None, "1"))
        st.append((x, "c" if x == "nogoal" else "b", "supplier", "a" if x != "lost" else "a; ghost", day(5), None, "1"))
    st += [("dupstep", "b", "supplier", "a", day(5), None, "1"), ("orphan", "a", "funding", "", day(1), None, "1")]
    got = {r["episode"]: (r["verdict"], r["reason"]) for r in N.verdicts(ep, spark.createDataFrame(st, ST), reactive=False)["verdicts"].collect()}
    assert got["ok"] == ("Non-binding", "")
    assert got["cycle"][1] == got["lost"][1] == "dependency cycle or unknown predecessor"
    assert got["nogoal"][1] == "required event step is not among the steps"
    assert got["undated"][1] == "not documented" and got["empty"][1] == "no steps recorded"
    assert got["badclock"][1] == got["dupstep"][1] == "input problems"
    assert got["orphan"] == ("Indeterminate", "listed in the steps but not in the episodes")


def test_v4_equals_v34_without_institutional_or_revealed_steps(tables):
    _, _, e, s = tables
    a = {r["episode"]: r["verdict"] for r in N.verdicts(e, s, reactive=False)["verdicts"].collect()}
    b = {r["episode"]: r["verdict"] for r in N.verdicts_v4(e, s)["verdicts"].collect()}
    assert a == b


def test_corner_check_and_reactive_run(tables):
    _, _, e, s = tables
    labels, syn = N.clock_set()
    ep, st, problems, notes = N.read_episodes(e, s, labels, syn)
    got = N.corner_check(ep, st, problems, notes, labels).collect()
    assert len(got) == 150 and all(r["corner_check"] for r in got)
    v = N.verdicts(e, s)["verdicts"].groupBy("reactive_sensitivity").count().collect()
    assert {r["reactive_sensitivity"] for r in v} >= {"Not applicable"}


def test_blocks_shuffle_the_steps_once_and_add_up_their_episodes(tables, monkeypatch):
    _, _, e, s = tables
    labels, syn = N.clock_set()
    ep, st, problems, notes = N.read_episodes(e, s, labels, syn)
    plan = N.propagate(ep, st, sorted(labels))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(episode") == 2  # the steps, and the episodes
    evaluated = N.evaluate(ep, st, problems, notes, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert evaluated.count("MapInArrow") == 1  # also with the reactive run
    rows = lambda limit: sorted(map(repr, N.evaluate(ep, st, problems, notes, labels, block_steps=limit).collect()))
    assert rows(0) == rows(2000)


def test_corners_are_evaluated_inside_their_block(tables, spark, monkeypatch):
    _, _, e, s = tables
    labels, syn = N.clock_set()
    # windows and anchors as intervals too, and an episode without steps
    e = e.selectExpr("episode", "anchor_earliest", "coalesce(anchor_latest, cast(cast(anchor_earliest as int) + 2 as string)) as anchor_latest", "tw_earliest", "coalesce(tw_latest, cast(cast(tw_earliest as int) + 6 as string)) as tw_latest", "r_step")
    e = e.unionByName(spark.createDataFrame([("none", "20000", "20002", "20009", "20012", "x")], e.schema))
    ep, st, problems, notes = N.read_episodes(e, s, labels, syn)
    written, write = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name="stage": written.append(name) or write(df, name))
    got = sorted(map(tuple, N.corner_check(ep, st, problems, notes, labels).collect()))
    assert not written  # neither paths nor corners
    monkeypatch.setattr(N, "CORNER_ROWS", 50)
    assert sorted(map(tuple, N.corner_check(ep, st, problems, notes, labels).collect())) == got
    assert sorted(map(tuple, N.corner_check(ep, st, problems, notes, labels, block_steps=0).collect())) == got
    assert "corner_steps" in written and len({r[2] for r in got}) >= 3
