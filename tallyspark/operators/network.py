"""Counterfactual critical-path verdicts on dependency networks.

Every step has a clock (who controls it), predecessors, a documented finish interval and
possibly an expected duration. An episode is late when its required step finishes after the
window; a clock binds when correcting its steps to their expected durations would have been
enough. Episodes are independent, so Spark partitions them and each block of whole episodes is
propagated level by level on arrays, all scenarios side by side. An episode too large for one
block goes through level rounds instead: a round joins the steps settled last with their outgoing
edges and keeps, per step, the latest ready time of each scenario, so that a large episode only
means more rows. The rounds together are one pass over the edges; their number is the longest chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions import dates
from tallyspark.functions.columns import alias_value, blank_to_null, lookup, normalize_text, number, require, split_list
from tallyspark.operators.describe import contingency, value_counts
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table

# Clocks with their labels, synonyms, tolerance, and words meaning yes.
EPS = 1e-9
FRAGILE_DAYS = 1.0
CLOCK_LABELS = {
    "finance": "Finance-binding",
    "payment": "Payment-binding",
    "fulfilment": "Fulfilment-binding",
    "logistics": "Logistics-binding",
    "operational-readiness": "Operational-readiness-binding",
}
CLOCK_SYNONYMS = {
    "financing": "finance",
    "funding": "finance",
    "fulfillment": "fulfilment",
    "supplier": "fulfilment",
    "production": "fulfilment",
    "dispatch": "logistics",
    "transport": "logistics",
    "delivery": "logistics",
    "customs": "logistics",
    "operational readiness": "operational-readiness",
    "readiness": "operational-readiness",
    "installation": "operational-readiness",
    "installation/set-up": "operational-readiness",
    "set-up": "operational-readiness",
    "setup": "operational-readiness",
    "commissioning": "operational-readiness",
    "training": "operational-readiness",
}
INSTITUTIONAL_LABEL = "Institution-binding"
INSTITUTIONAL_SYNONYMS = (
    "customs", "customs clearance", "clearance", "origin", "proof of origin", "classification", "tariff", "duty", "release", "regulatory",
    "product control", "conformity", "institution",
)
YES = ("yes", "y", "true", "1", "igen", "evet", "بله")
LAYERS = ("focal-firm", "counterparty", "intermediary", "institutional", "environmental")
LAYER_STATES = {"activated": "Activated", "a": "Activated", "exposed": "Exposed", "e": "Exposed", "not present": "Not present", "n": "Not present", "unknown": "Unknown", "u": "Unknown"}
EX_ANTE_STATUS = {
    "documented": "documented", "d": "documented", "s-d": "documented",
    "revealed": "revealed", "r": "revealed", "s-r": "revealed", "revealed in process": "revealed",
    "undocumented": "undocumented", "u": "undocumented", "s-u": "undocumented",
}
SOURCE_CLASSES = ("internal", "counterparty", "third-party", "public-authority")


def clock_set(institutional: bool = False, merge_institutional: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """Labels and synonyms of the clocks: the five-clock set, the six-clock set, or the six-clock inputs merged into five."""
    synonyms = dict(CLOCK_SYNONYMS)
    if not institutional:
        return dict(CLOCK_LABELS), synonyms
    synonyms |= {w: "institutional" for w in INSTITUTIONAL_SYNONYMS}
    if merge_institutional:
        return dict(CLOCK_LABELS), {w: "logistics" if c == "institutional" else c for w, c in synonyms.items()} | {"institutional": "logistics"}
    return {**CLOCK_LABELS, "institutional": INSTITUTIONAL_LABEL}, synonyms


def _first_days(df: DataFrame, low: str, high: str) -> tuple[Column, Column]:
    a = dates.days_of(df, low)
    return a, F.coalesce(dates.days_of(df, high), a)


def _present(texts: Sequence[Column]) -> Column:
    """The texts that are not null; the list is only formed in rows that have one."""
    return F.when(F.coalesce(*texts).isNotNull(), F.array_compact(F.array(*texts))).otherwise(F.expr("cast(array() as array<string>)"))


def _zones(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Whether any, and whether every given time of the row has an offset."""
    z = [dates.offset_of(df, n) for n in names]
    return [F.greatest(*z).alias("zone"), F.least(*z).alias("every")]


def read_episodes(episodes: DataFrame, steps: DataFrame, labels: Mapping[str, str], synonyms: Mapping[str, str], zero_as_documented: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Typed episodes and steps, one row per input problem, and notes on durations treated as missing.

    Date columns may be text in any accepted spelling or timestamps.
    """
    require(episodes, ["episode", "anchor_earliest", "tw_earliest", "r_step"])
    require(steps, ["episode", "step", "clock", "finish_earliest"])
    optional = lambda d, names: d.withColumns({n: F.lit(None).cast("string") for n in names if n not in d.columns})
    # rows are kept or dropped by a pattern that ends at the first letter, so codes are normalised once, and not for the filter too
    named = lambda c: F.col(c).cast("string").rlike(r"(?U)\S")
    ep = optional(episodes, ["anchor_latest", "tw_latest"]).where(named("episode")).withColumns({"episode": normalize_text("episode"), "r_step": normalize_text("r_step")})
    st = optional(steps, ["predecessors", "finish_latest", "expected_days", "zero_documented"]).where(named("episode") & named("step")).withColumns({"episode": normalize_text("episode"), "step": normalize_text("step")})
    a, b = _first_days(ep, "anchor_earliest", "anchor_latest")
    c, d = _first_days(ep, "tw_earliest", "tw_latest")
    ep_cols, st_cols = ["anchor_earliest", "anchor_latest", "tw_earliest", "tw_latest"], ["finish_earliest", "finish_latest"]
    # read once, as every evaluation and check starts from them
    ep = materialize(ep.select("episode", "r_step", a.alias("anchor_lo"), b.alias("anchor_hi"), c.alias("tw_lo"), d.alias("tw_hi"), _present([dates.problem_of(ep, x) for x in ep_cols]).alias("found"), *_zones(ep, ep_cols)), "typed_episodes")
    typed_ep = ep.select("episode", "r_step", "anchor_lo", "anchor_hi", "tw_lo", "tw_hi")
    zoned = any(dates.may_have_offset(x, n) for x, names in ((episodes, ep_cols), (steps, st_cols)) for n in names)
    lo, hi = _first_days(st, "finish_earliest", "finish_latest")
    # columns of their own: as expressions they would be worked out again wherever they are used
    st = st.withColumns({"_clock": F.lower(normalize_text("clock")), "_exp": number("expected_days"), "_raw_exp": blank_to_null("expected_days")}).withColumn("_clock", F.coalesce(lookup(F.col("_clock"), synonyms), F.col("_clock")))
    clock, exp = F.col("_clock"), F.col("_exp")
    zero = (F.abs(exp) < EPS) & ~F.coalesce(F.lower(F.trim(F.col("zero_documented").cast("string"))).isin(*YES), F.lit(False)) & F.lit(not zero_as_documented)
    dropped = F.coalesce(zero, F.lit(False))
    say = lambda text: F.concat(F.lit("step "), F.col("step"), F.lit(f": {text}"))
    raw_exp = F.col("_raw_exp")
    found = _present([
        F.concat(say(""), dates.problem_of(st, "finish_earliest")),
        F.concat(say(""), dates.problem_of(st, "finish_latest")),
        F.when(raw_exp.isNotNull() & exp.isNull(), say("expected_days is not a number")),
        F.when(hi < lo, say("latest finish is before earliest finish")),
        F.when(exp < 0, say("negative expected duration")),
        F.when(~F.coalesce(clock.isin(*labels), F.lit(False)), F.concat(say("clock '"), F.when(clock == "", "(blank)").otherwise(clock), F.lit("' is not one of " + ", ".join(labels)))),
    ])
    # the source is read once: types and row problems are written together
    typed = materialize(st.select(
        "episode", "step", clock.alias("clock"), split_list("predecessors").alias("preds"), lo.alias("f_lo"), hi.alias("f_hi"), F.when(~dropped, exp).alias("expected"),
        dropped.alias("zero_dropped"), found.alias("found"), *_zones(st, st_cols)), "typed")
    row_checks = typed.select("episode", F.explode("found").alias("problem"))
    dup_steps = typed.groupBy("episode", "step").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("episode", F.concat(F.lit("duplicate step name "), "step").alias("problem"))
    dup_ep = ep.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("episode", F.concat(F.lit("episode code "), "episode", F.lit(" appears more than once")).alias("problem"))
    ep_dates = ep.select("episode", F.explode("found").alias("problem"))
    problems = [row_checks, dup_steps, dup_ep, ep_dates]
    if zoned:
        zones = ep.select("episode", "zone", "every").unionByName(typed.select("episode", "zone", "every"))
        mixed = zones.groupBy("episode").agg(F.bool_or("zone").alias("any"), F.bool_and("every").alias("all")).where("any and not all").select(
            "episode", F.lit("some times have a time-zone offset and others do not").alias("problem"))
        problems.append(mixed.join(typed_ep.select("episode").distinct(), "episode", "left_semi"))
    problems = reduce(DataFrame.unionByName, problems)
    notes = typed.where("zero_dropped").select("episode", F.concat(F.lit("step "), "step", F.lit(": ex-ante duration 0 without zero_documented = Yes, treated as missing")).alias("note"))
    return typed_ep, typed.select("episode", "step", "clock", "preds", "f_lo", "f_hi", "expected"), problems, notes


def edges_of(steps: DataFrame) -> DataFrame:
    return steps.select("episode", "step", F.explode(F.array_distinct("preds")).alias("pred"))


def realised_durations(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds ready and realised duration at both date bounds; ``unknown`` counts predecessors that are not steps.

    A step without predecessors is ready at the anchor. Negative durations become zero and are flagged.
    """
    e = edges_of(steps)
    p = steps.select("episode", F.col("step").alias("pred"), F.col("f_lo").alias("p_lo"), F.col("f_hi").alias("p_hi"), F.lit(1).alias("known"))
    per = e.join(p, ["episode", "pred"], "left").groupBy("episode", "step").agg(
        F.max("p_lo").alias("m_lo"), F.max("p_hi").alias("m_hi"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n_preds"))
    anchors = episodes.select("episode", "anchor_lo", "anchor_hi")
    d = steps.join(anchors, "episode").join(per, ["episode", "step"], "left").withColumns({"n_preds": F.coalesce("n_preds", F.lit(0)), "unknown": F.coalesce("unknown", F.lit(0))})
    ready = lambda b: F.when(F.col("n_preds") == 0, F.col(f"anchor_{b}")).otherwise(F.col(f"m_{b}"))
    d = d.withColumns({"ready_lo": ready("lo"), "ready_hi": ready("hi")})
    gap = lambda b: F.col(f"f_{b}") - F.col(f"ready_{b}")
    return d.withColumns({
        "real_lo": F.greatest(gap("lo"), F.lit(0.0)), "real_hi": F.greatest(gap("hi"), F.lit(0.0)),
        "early_lo": F.coalesce(gap("lo") < -EPS, F.lit(False)), "early_hi": F.coalesce(gap("hi") < -EPS, F.lit(False))}).drop("m_lo", "m_hi")


def scenarios(clocks: Sequence[str]) -> list[tuple[str, ...]]:
    """Corrections that a verdict can need: none, each clock, each pair, all."""
    cs = sorted(clocks)
    return [(), *[(c,) for c in cs], *combinations(cs, 2), tuple(cs)]


def _mask(sub: Sequence[str], clocks: Sequence[str]) -> int:
    return sum(1 << sorted(clocks).index(c) for c in sub)


def forward(steps: DataFrame, clocks: Sequence[str], reactive: bool = False) -> tuple[DataFrame, int]:
    """Level of every step and its finish time under every scenario at both bounds.

    ``steps`` comes from :func:`realised_durations`. Steps on a cycle, or behind one, or behind an
    unknown predecessor, are never settled and are absent from the result.
    """
    subs = scenarios(clocks)
    masks = [_mask(s, clocks) for s in subs]
    own = F.lit(0)
    for i, c in enumerate(sorted(clocks)):
        own = F.when(F.col("clock") == c, F.lit(1 << i)).otherwise(own)
    base = steps.select("episode", "step", "n_preds", "ready_lo", "ready_hi", "real_lo", "real_hi", "expected", own.alias("own"), F.array_distinct("preds").alias("preds"))
    edges = materialize(base.select("episode", F.explode("preds").alias("pred"), "step", "n_preds", "real_lo", "real_hi", "expected", "own"), "edges")
    slots = [(b, k) for b in ("lo", "hi") for k in range(len(subs))]

    def settle(ready: list[Column], up: Column) -> list[Column]:
        """Finish under each scenario from the ready times; ``up`` are the clocks found upstream."""
        out = []
        for (b, k), r in zip(slots, ready):
            m = masks[k]
            hit = F.col("own").bitwiseAND(F.lit(m)) != 0
            if reactive:
                hit = hit | (up.bitwiseAND(F.lit(m)) != 0)
            real = F.col(f"real_{b}")
            out.append(r + F.when(hit & F.col("expected").isNotNull(), F.least(real, F.col("expected"))).otherwise(real) if m else r + real)
        return out

    zero = F.lit(0)
    roots = base.where("n_preds = 0")
    fins = settle([F.col(f"ready_{b}") for b, _ in slots], zero)
    level = roots.select("episode", "step", F.lit(0).alias("level"), F.col("own").alias("seen"), F.array(*fins).alias("fin"))
    level = materialize(level, "level")
    done, rounds, waiting = [level], 0, None
    while True:
        moved = edges.join(level.select("episode", F.col("step").alias("pred"), "seen", "fin"), ["episode", "pred"])
        part = moved.select("episode", "step", "n_preds", "real_lo", "real_hi", "expected", "own", F.lit(1).alias("got"), F.col("seen").alias("up"), *[F.col("fin")[i].alias(f"r{i}") for i in range(len(slots))])
        if waiting is not None:
            part = part.unionByName(waiting)
        agg = part.groupBy("episode", "step").agg(
            *[F.first(c).alias(c) for c in ("n_preds", "real_lo", "real_hi", "expected", "own")], F.sum("got").alias("got"), F.bit_or("up").alias("up"),
            *[F.max(f"r{i}").alias(f"r{i}") for i in range(len(slots))])
        agg = materialize(agg, "ready")
        rounds += 1
        full = agg.where("got = n_preds")
        fins = settle([F.col(f"r{i}") for i in range(len(slots))], F.col("up"))
        level = full.select("episode", "step", F.lit(rounds).alias("level"), F.col("own").bitwiseOR(F.col("up")).alias("seen"), F.array(*fins).alias("fin"))
        if full.isEmpty():
            break
        level = materialize(level, "level")
        done.append(level)
        waiting = agg.where("got < n_preds").withColumn("got", F.col("got").cast("int")).select(*part.columns)
    return reduce(DataFrame.unionByName, done), rounds


def backward(episodes: DataFrame, steps: DataFrame, settled: DataFrame, rounds: int) -> DataFrame:
    """Steps on a path to the required step, with the latest finish the window allows at expected durations.

    ``lf_*`` is null, and ``lf_open`` true, where an expected duration needed on the way is missing.
    """
    pos = settled.select("episode", "step", "level")
    info = steps.select("episode", "step", "expected", F.array_distinct("preds").alias("preds"))
    nodes = materialize(info.join(pos, ["episode", "step"]), "nodes")
    edges = materialize(nodes.select("episode", "step", F.explode("preds").alias("pred")), "back_edges")
    target = episodes.select("episode", F.col("r_step").alias("step"), F.col("tw_lo").alias("lf_lo"), F.col("tw_hi").alias("lf_hi"), F.lit(False).alias("lf_open"))
    pend = target.join(nodes.select("episode", "step", "expected", "level"), ["episode", "step"])
    pend = materialize(pend.select("episode", "step", "expected", "level", "lf_lo", "lf_hi", "lf_open"), "pend")
    out = []
    for level in range(rounds, -1, -1):
        here = pend.where(F.col("level") == level)
        if here.isEmpty():
            continue
        here = materialize(here.groupBy("episode", "step", "expected", "level").agg(F.min("lf_lo").alias("lf_lo"), F.min("lf_hi").alias("lf_hi"), F.bool_or("lf_open").alias("lf_open")), "here")
        out.append(here)
        need = F.col("expected").isNull() | F.col("lf_open")
        down = here.join(edges, ["episode", "step"]).select(
            "episode", F.col("pred").alias("step"), F.when(~need, F.col("lf_lo") - F.col("expected")).alias("lf_lo"), F.when(~need, F.col("lf_hi") - F.col("expected")).alias("lf_hi"), need.alias("lf_open"))
        down = down.join(nodes.select("episode", "step", "expected", "level"), ["episode", "step"]).select(*pend.columns)
        pend = materialize(pend.where(F.col("level") < level).unionByName(down), "pend")
    return reduce(DataFrame.unionByName, out)


def _verdict(b: str, clocks: Sequence[str], labels: Mapping[str, str]) -> Column:
    """Verdict of one date bound from the slacks ``s_<b>_<k>`` and the testable clocks of the path."""
    cs = sorted(clocks)
    subs = scenarios(clocks)
    s = lambda sub: F.col(f"s_{b}_{subs.index(sub)}")
    ok = lambda c: c >= -EPS
    on = lambda c: F.array_contains("clocks", c)
    testable = lambda c: on(c) & ~F.array_contains("untestable", c)
    base = s(())
    singles = F.array_compact(F.array(*[F.when(testable(c) & ok(s((c,))), F.struct(F.lit(c).alias("name"), s((c,)).alias("slack"))) for c in cs]))
    pairs = F.array_compact(F.array(*[F.when(testable(p[0]) & testable(p[1]) & ok(s(p)), F.struct(F.lit(" + ".join(p)).alias("name"), s(p).alias("slack"))) for p in combinations(cs, 2)]))
    names = lambda arr: F.transform(arr, lambda x: x["name"])
    best = lambda arr: F.array_max(F.transform(arr, lambda x: x["slack"]))
    none = F.expr("cast(array() as array<string>)")
    res = lambda v, cl, sl, un: F.struct(v.alias("verdict"), cl.alias("clocks"), sl.alias("slack"), un.alias("untestable"))
    everything = s(tuple(cs))
    one = F.element_at(names(singles), 1)
    single_label = F.lit(None).cast("string")
    for c in cs:
        single_label = F.when(one == c, labels[c]).otherwise(single_label)
    size = F.size("clocks")
    return (
        F.when(ok(base), res(F.lit("Non-binding"), none, base, none))
        .when(F.size(singles) == 1, res(single_label, names(singles), best(singles), F.col("untestable")))
        .when(F.size(singles) > 1, res(F.lit("Multiple sufficient corrections"), names(singles), best(singles), F.col("untestable")))
        .when(F.size("untestable") > 0, res(F.lit("Indeterminate"), none, base, F.col("untestable")))
        .when(F.size(pairs) > 0, res(F.lit("Jointly binding"), names(pairs), best(pairs), none))
        .when((size > 2) & ok(everything), res(F.lit("Jointly binding"), F.array(F.array_join("clocks", " + ")), everything, none))
        .otherwise(res(F.lit("Window infeasible at ex-ante durations"), none, everything, none)))


def _slacks(paths: DataFrame, fin: str, n: int) -> DataFrame:
    """Slack of the required step per scenario: window minus finish."""
    return paths.withColumns({f"s_{b}_{k}": F.col(f"tw_{b}") - F.get(fin, F.lit(j * n + k)) for j, b in enumerate(("lo", "hi")) for k in range(n)}).drop(fin)


def _slack_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("s_lo_", "s_hi_"))]


def _same(a: Column, b: Column) -> Column:
    return (a["verdict"] == b["verdict"]) & (F.array_sort(a["clocks"]) == F.array_sort(b["clocks"]))


def _durations(real: np.ndarray, exp: np.ndarray, own: np.ndarray, masks: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
    """Duration of each step under each scenario, earliest bounds first (rows x 2 scenarios); ``seen`` are the clocks upstream, where they count."""
    hit = (own[:, None] & masks) != 0
    if seen is not None:
        hit |= (seen[:, None] & masks) != 0
    hit &= ~np.isnan(exp)[:, None]
    return np.concatenate([np.where(hit, np.fmin(real[:, b], exp)[:, None], real[:, b, None]) for b in range(real.shape[1])], axis=1)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _begin(anchor: np.ndarray, done: np.ndarray, root: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """When each step is ready at its documented dates: when its last predecessor has finished, or at the anchor. Edges are ordered by ``dst``."""
    start = np.where(root[:, None], anchor, np.nan)
    first = _runs(dst)
    if len(first):
        start[dst[first]] = np.fmax(start[dst[first]], np.fmax.reduceat(done[src], first, axis=0))
    return start


def _finishes(level: np.ndarray, start: np.ndarray, real: np.ndarray, exp: np.ndarray, own: np.ndarray, seen: np.ndarray | None, src: np.ndarray, dst: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Finish of each step under each scenario, level by level, bounds one after the other; steps that cannot be ordered have none."""
    fin = np.full((len(level), real.shape[1] * len(masks)), np.nan)
    at = level[dst]
    for k in range(level.max(initial=-1) + 1):
        rows = np.flatnonzero(level == k)
        e = np.flatnonzero(at == k)
        # every row has predecessors from the second round on, so the runs of its edges are the rows
        ready = np.fmax(np.fmax.reduceat(fin[src[e]], _runs(dst[e]), axis=0), -np.inf) if k else np.repeat(start[rows], len(masks), axis=1)
        fin[rows] = ready + _durations(real[rows], exp[rows], own[rows], masks, None if seen is None else seen[rows])
    return fin


class _Block:
    """Forward and backward propagation over the whole episodes of one block, level by level, on arrays.

    ``masks`` may be None where only levels and paths are asked for. ``fins`` has the finishes for each entry of ``reactive``.
    """

    def __init__(self, rows: pa.Table, masks: np.ndarray | None, reactive: Sequence[bool]):
        n = self.n = rows.num_rows
        text = lambda c: rows.column(c).combine_chunks()
        both = lambda x: np.stack([rows.column(f"{x}_{b}").to_numpy() for b in ("lo", "hi")], axis=1).astype(float)
        code_of = lambda a: a.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        self.eid = eid = code_of(text("episode"))
        lists = text("preds")
        preds = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
        dst = np.repeat(np.arange(n), preds)
        code = code_of(pa.concat_arrays([text("step"), lists.flatten()]))
        size = code.max() + 1
        key, want = eid * size + code[:n], eid[dst] * size + code[n:]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        again = order[1:][ranked[1:] == ranked[:-1]]
        self.twice = np.zeros(n, bool)
        self.twice[again] = True
        at = np.minimum(np.searchsorted(ranked, want), n - 1)
        known = ranked[at] == want
        self.src, self.dst = src, dst = order[at][known], dst[known]  # by dst
        self.own = own = rows.column("own").to_numpy().astype(np.int64)
        self.exp = exp = rows.column("expected").to_numpy().astype(float)
        self.is_goal = rows.column("is_goal").fill_null(False).to_numpy()
        self.root = root = preds == 0
        self.done, self.anchor, self.tw = done, anchor, tw = both("f"), both("anchor"), both("tw")
        start = _begin(anchor, done, root, src, dst)
        gap = done - start
        self.early, self.real = gap < -EPS, np.maximum(gap, 0.0)
        self.level, seen = np.full(n, -1), np.zeros(n, np.int64)
        rounds, now, got = 0, root, np.zeros(n, np.int64)
        while now.any():
            rows_now = np.flatnonzero(now)
            e = np.flatnonzero(now[dst]) if rounds else np.zeros(0, np.int64)
            d, f = dst[e], _runs(dst[e])
            self.level[rows_now] = rounds
            if len(e):
                seen[d[f]] = np.bitwise_or.reduceat(seen[src[e]] | own[src[e]], f)
            got += np.bincount(dst[now[src]], minlength=n)
            now = (self.level < 0) & (got == preds)
            rounds += 1
        self.fins = [_finishes(self.level, start, self.real, exp, own, seen if r else None, src, dst, masks) for r in reactive] if masks is not None else []
        self.goal = goal = self.is_goal & (self.level >= 0)
        lf = np.where(goal[:, None], tw, np.inf)
        self.on, self.open = on, open_ = goal.copy(), np.zeros(n, bool)
        back = np.argsort(src, kind="stable")
        b_src, b_dst = src[back], dst[back]
        for k in range(rounds - 1, 0, -1):
            e = (self.level[b_dst] == k) & on[b_dst]
            s, t = b_src[e], b_dst[e]
            if not len(s):
                continue
            need, f = open_[t] | np.isnan(exp[t]), _runs(s)
            lf[s[f]] = np.fmin(lf[s[f]], np.fmin.reduceat(np.where(need[:, None], np.inf, lf[t] - exp[t][:, None]), f, axis=0))
            open_[s[f]] |= np.logical_or.reduceat(need, f)
            on[s] = True
        self.lf = np.where(np.isfinite(lf) & on[:, None] & ~open_[:, None], lf, np.nan)

    def fin_lists(self, fin: np.ndarray | None, rows: np.ndarray, has: np.ndarray) -> pa.Array:
        """The finishes of ``rows`` as lists, null where not ``has``."""
        if fin is None:
            return pa.nulls(len(rows), pa.list_(pa.float64()))
        ends = np.r_[0, np.cumsum(np.where(has, fin.shape[1], 0))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[~has, False]), pa.array(fin[rows[has]].ravel(), from_pandas=True))


_plain = lambda x: pa.array(x, from_pandas=True)  # noqa: E731  (NaN as null)


def _step_rows(rows: pa.Table, masks: np.ndarray | None, reactive: bool) -> pa.RecordBatch:
    b = _Block(rows, masks, [reactive])
    cols = {c: rows.column(c).combine_chunks() for c in PASS_COLUMNS}
    cols |= {"early_lo": _plain(b.early[:, 0]), "early_hi": _plain(b.early[:, 1]), "is_goal": _plain(b.is_goal), "level": _plain(b.level.astype(np.int32)), "on_path": _plain(b.on), "lf_open": _plain(b.open),
             "lf_lo": _plain(b.lf[:, 0]), "lf_hi": _plain(b.lf[:, 1]), "real_lo": _plain(b.real[:, 0]), "real_hi": _plain(b.real[:, 1]), "fin": b.fin_lists(b.fins[0] if b.fins else None, np.arange(b.n), b.goal)}
    return pa.RecordBatch.from_pydict(cols)


def _episode_batch(rows: pa.Table, masks: np.ndarray, reactive: Sequence[bool], finance: int) -> pa.RecordBatch:
    b = _Block(rows, masks, reactive)
    at = _runs(b.eid)
    add = lambda x: _plain(np.add.reduceat(x.astype(np.int64), at))
    some = lambda x: np.logical_or.reduceat(x, at)
    bits = lambda x: _plain(np.bitwise_or.reduceat(np.where(x, b.own, 0), at))
    fin = b.on & (b.own == finance) & (finance > 0)
    slack = np.fmin.reduceat(np.where(fin[:, None], b.lf - b.done, np.nan), at, axis=0)
    first = np.minimum.reduceat(np.where(b.goal, np.arange(b.n), b.n), at)
    has = first < b.n
    cols = {"episode": rows.column("episode").combine_chunks().take(pa.array(at)), "n_steps": add(np.ones(b.n)), "dup": _plain(some(b.twice)), "has_r": _plain(some(b.is_goal)), "acyclic": _plain(~some(b.level < 0)), "on_bits": bits(b.on), "gap_bits": bits(b.on & np.isnan(b.exp)),
            "undated": add(b.on & np.isnan(b.done[:, 0])), "floored_lo": add(b.on & b.early[:, 0]), "floored_hi": add(b.on & b.early[:, 1]), "finance_steps": add(fin), "open": _plain(some(b.on & b.open)),
            "fs_lo": _plain(slack[:, 0]), "fs_hi": _plain(slack[:, 1])}
    cols |= {f"fin{k}": b.fin_lists(x, first, has) for k, x in enumerate(b.fins)}
    return pa.RecordBatch.from_pydict(cols)


PASS_COLUMNS = ["episode", "step", "clock", "f_lo", "f_hi", "expected"]
PROPAGATED = ("episode string, step string, clock string, f_lo double, f_hi double, expected double, early_lo boolean, early_hi boolean, is_goal boolean, "
              "level int, on_path boolean, lf_open boolean, lf_lo double, lf_hi double, real_lo double, real_hi double, fin array<double>")
SUMMARY = ("episode string, n_steps long, dup boolean, has_r boolean, acyclic boolean, on_bits long, gap_bits long, undated long, floored_lo long, floored_hi long, finance_steps long, open boolean, "
           "fs_lo double, fs_hi double")

#: Episodes with more steps than this are not laid out in one block; they go through the level rounds.
BLOCK_STEPS = 2000


def _split(steps: DataFrame, block_steps: int) -> tuple[DataFrame, DataFrame | None]:
    """Steps of episodes of ordinary size, and the codes of the larger ones, if there are any."""
    big = steps.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_steps).select("episode")
    if big.isEmpty():
        return steps, None
    big = materialize(big, "large_episodes")
    return steps.join(big, "episode", "left_anti"), big


def _own_bit(clocks: Sequence[str]) -> Column:
    own = F.lit(0)
    for i, c in enumerate(sorted(clocks)):
        own = F.when(F.col("clock") == c, F.lit(1 << i)).otherwise(own)
    return own


def _in_blocks(episodes: DataFrame, steps: DataFrame, clocks: Sequence[str], solve_block, schema: str) -> DataFrame:
    """Solve whole episodes in blocks of Arrow rows. Both sides are dealt by episode before they are joined, so the rows are shuffled once."""
    goal = episodes.select("episode", "r_step", "anchor_lo", "anchor_hi", "tw_lo", "tw_hi")
    st = steps.select(*PASS_COLUMNS, F.array_distinct("preds").alias("preds"), _own_bit(clocks).alias("own"))
    flat = st.repartition("episode").join(goal.repartition("episode"), "episode").select(
        *PASS_COLUMNS, "preds", "anchor_lo", "anchor_hi", "own", (F.col("step") == F.col("r_step")).alias("is_goal"), "tw_lo", "tw_hi")

    def solve(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            cut = pc.index(t.column("episode"), t.column("episode")[-1]).as_py()  # the last episode may go on in the next batch
            whole, rest = t.slice(0, cut), t.slice(cut)
            if cut:
                yield solve_block(whole)
        if rest is not None and rest.num_rows:
            yield solve_block(rest)

    return flat.sortWithinPartitions("episode").mapInArrow(solve, schema)


def propagate(episodes: DataFrame, steps: DataFrame, clocks: Sequence[str], reactive: bool = False, block_steps: int = BLOCK_STEPS, finishes: bool = True) -> DataFrame:
    """Level, path membership, realised duration and latest finish of every step, and the scenario finishes of the required step.

    Episodes of ordinary size are solved in blocks of whole episodes; larger ones, which must not sit in
    one task, in level rounds. Steps that cannot be ordered have level -1. Without ``finishes`` the column ``fin`` is null.
    """
    small, big = _split(steps, block_steps)
    masks = np.array([_mask(s, clocks) for s in scenarios(clocks)], np.int64) if finishes else None
    rows = _in_blocks(episodes, small, clocks, lambda t: _step_rows(t, masks, reactive), PROPAGATED)
    return rows if big is None else rows.unionByName(_in_rounds(episodes, steps, big, clocks, reactive))


def _in_rounds(episodes: DataFrame, steps: DataFrame, big: DataFrame, clocks: Sequence[str], reactive: bool) -> DataFrame:
    """As :func:`propagate`, for the episodes in ``big``."""
    ep = episodes.join(big, "episode", "left_semi")
    large = materialize(realised_durations(ep, steps.join(big, "episode", "left_semi")), "large_steps")
    settled, rounds = forward(large, clocks, reactive)
    back = backward(ep, large, settled, rounds).select("episode", "step", "lf_lo", "lf_hi", "lf_open", F.lit(True).alias("on_path"))
    at_goal = ep.select("episode", F.col("r_step").alias("step"), F.lit(True).alias("g"))
    fins = settled.join(at_goal, ["episode", "step"], "left").select("episode", "step", "level", F.when(F.col("g"), F.col("fin")).alias("fin"))
    rows = large.select(*PASS_COLUMNS, "early_lo", "early_hi", "real_lo", "real_hi").join(at_goal, ["episode", "step"], "left").withColumn("is_goal", F.coalesce("g", F.lit(False))).join(fins, ["episode", "step"], "left").join(back, ["episode", "step"], "left")
    return rows.select(*PASS_COLUMNS, "early_lo", "early_hi", "is_goal", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("on_path", F.lit(False)).alias("on_path"),
                       F.coalesce("lf_open", F.lit(False)).alias("lf_open"), "lf_lo", "lf_hi", "real_lo", "real_hi", "fin")


def _summary(moved: DataFrame, clocks: Sequence[str], finance: int) -> DataFrame:
    """Rows of :func:`propagate` added up by episode, without ``dup``."""
    on, own = F.col("on_path"), _own_bit(clocks)
    fin = on & (own == finance) if finance else F.lit(False)
    bits = lambda x: F.bit_or(F.when(x, own).otherwise(0).cast("long"))
    return moved.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n_steps"), F.bool_or("is_goal").alias("has_r"), F.bool_and(F.col("level") >= 0).alias("acyclic"), bits(on).alias("on_bits"), bits(on & F.col("expected").isNull()).alias("gap_bits"),
        F.count_if(on & F.col("f_lo").isNull()).alias("undated"), F.count_if(on & F.col("early_lo")).alias("floored_lo"), F.count_if(on & F.col("early_hi")).alias("floored_hi"), F.count_if(fin).alias("finance_steps"),
        F.bool_or(on & F.col("lf_open")).alias("open"), F.min(F.when(fin, F.col("lf_lo") - F.col("f_lo"))).alias("fs_lo"), F.min(F.when(fin, F.col("lf_hi") - F.col("f_hi"))).alias("fs_hi"), F.first("fin", ignorenulls=True).alias("fin0"))


def _episode_rows(episodes: DataFrame, steps: DataFrame, clocks: Sequence[str], reactive: bool, block_steps: int) -> DataFrame:
    """One row per episode: sanity counts, path clocks, finance slack, the scenario finishes ``fin0`` and, if asked for, the reactive ones ``fin1``.

    Blocks give these rows themselves; only episodes above ``block_steps`` are added up from their steps.
    """
    cs = sorted(clocks)
    masks = np.array([_mask(s, clocks) for s in scenarios(clocks)], np.int64)
    finance = 1 << cs.index("finance") if "finance" in cs else 0
    kinds = [False, True] if reactive else [False]
    schema = SUMMARY + "".join(f", fin{k} array<double>" for k in range(len(kinds)))
    small, big = _split(steps, block_steps)
    per = _in_blocks(episodes, small, clocks, lambda t: _episode_batch(t, masks, kinds, finance), schema)
    if big is not None:
        mine = steps.join(big, "episode", "left_semi")
        dup = materialize(mine.groupBy("episode", "step").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("episode").distinct(), "large_dup")
        unique, rest = mine.join(dup, "episode", "left_anti"), big.join(dup, "episode", "left_anti")
        large = _summary(_in_rounds(episodes, unique, rest, clocks, False), clocks, finance).withColumn("dup", F.lit(False))
        if reactive:
            again = _in_rounds(episodes, unique, rest, clocks, True).where("fin is not null").select("episode", F.col("fin").alias("fin1"))
            large = large.join(again, "episode", "left")
        per = per.unionByName(large).unionByName(dup.select("episode", F.lit(True).alias("dup")), allowMissingColumns=True)
    listed = lambda c: F.array_compact(F.array(*[F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(cs)]))
    per = per.withColumns({"clocks": listed("on_bits"), "untestable": listed("gap_bits")}).drop("on_bits", "gap_bits")
    return episodes.join(per, "episode", "left")


def evaluate(episodes: DataFrame, steps: DataFrame, problems: DataFrame, notes: DataFrame, labels: Mapping[str, str], reactive: bool = True, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Verdict row per episode from typed tables (see :func:`read_episodes`)."""
    clocks = sorted(labels)
    once = episodes.groupBy("episode").agg(*[F.min(c).alias(c) for c in episodes.columns if c != "episode"])
    s = _slacks(_episode_rows(once, steps, clocks, reactive, block_steps), "fin0", len(scenarios(clocks)))
    t = s.withColumns({"v_lo": _verdict("lo", clocks, labels), "v_hi": _verdict("hi", clocks, labels), "base_lo": F.col("s_lo_0"), "base_hi": F.col("s_hi_0")})
    if reactive:
        t = _slacks(t.drop(*_slack_names(t)), "fin1", len(scenarios(clocks)))
        t = t.withColumns({"w_lo": _verdict("lo", clocks, labels), "w_hi": _verdict("hi", clocks, labels)})
    t = t.drop(*_slack_names(t))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    said = problems.select("episode", one.alias("p"), none.alias("z")).unionByName(notes.select("episode", none.alias("p"), one.alias("z")))
    t = t.join(said.groupBy("episode").agg(F.sum("p").alias("n_problems"), F.sum("z").alias("zero_notes")), "episode", "left")
    halted = (F.when(F.col("dup"), "input problems").when(F.col("n_steps").isNull(), "no steps recorded").when(~F.col("has_r"), "required event step is not among the steps")
              .when(~F.col("acyclic"), "dependency cycle or unknown predecessor")
              .when(F.col("tw_lo").isNull() | F.col("anchor_lo").isNull() | (F.col("undated") > 0), "not documented").when(F.col("n_problems") > 0, "input problems"))
    t = t.withColumn("halted", halted)
    stable = _same(F.col("v_lo"), F.col("v_hi"))
    run = F.col("halted").isNull()
    outcome = F.when(run & stable, F.col("v_lo.verdict")).when(run, "Indeterminate")
    unclear = ("Multiple sufficient corrections", "Window infeasible at ex-ante durations")
    verdict = F.when(~run, "Indeterminate").when(outcome.isin(*unclear), "Indeterminate").otherwise(outcome)
    why = (F.when(~run, "missing-inputs").when(verdict != "Indeterminate", "").when(~stable, "sign-unstable").when(outcome == unclear[1], "window-infeasible")
           .when(outcome == unclear[0], "multiple-sufficient").otherwise("missing-inputs"))
    round4 = lambda c: F.when(run, F.round(c, 4))
    t = t.withColumns({
        "verdict": verdict, "engine_outcome": F.coalesce(outcome, F.lit("")), "indeterminate_reason": why, "sign_stable": F.when(run, F.when(stable, "Yes").otherwise("No")).otherwise(""),
        "binding_clocks": F.when(run & stable, F.array_join("v_lo.clocks", "; ")).otherwise(""),
        "decisive_slack_earliest": round4(F.col("v_lo.slack")), "decisive_slack_latest": round4(F.col("v_hi.slack")), "baseline_slack_earliest": round4(F.col("base_lo")),
        "baseline_slack_latest": round4(F.col("base_hi")), "finance_slack_earliest": round4(F.when(~F.col("open"), F.col("fs_lo"))), "finance_slack_latest": round4(F.when(~F.col("open"), F.col("fs_hi")))})
    fe, fl = F.col("finance_slack_earliest"), F.col("finance_slack_latest")
    act = (F.when(~run, "").when(fe.isNull() | fl.isNull(), F.when(F.col("finance_steps") == 0, "N/A").otherwise("Not computable")).when((fe >= -EPS) & (fl >= -EPS), "Yes")
           .when((fe < -EPS) & (fl < -EPS), "No").otherwise("Unstable across bounds"))
    near = lambda c: F.coalesce(F.abs(F.col(c)) <= FRAGILE_DAYS + EPS, F.lit(False))
    t = t.withColumns({
        "finance_actionable": act, "fragile": F.when(run, F.when(near("decisive_slack_earliest") | near("decisive_slack_latest"), "Yes").otherwise("No")).otherwise(""),
        "reason": F.coalesce(F.col("halted"), F.when(verdict == "Indeterminate", why), F.lit("")), "n_flags": F.coalesce("n_problems", F.lit(0)) + F.coalesce("zero_notes", F.lit(0))})
    t = t.withColumn("flags", _flags(run))
    if reactive:
        t = _reactive(t)
    return t.select(*VERDICT_COLUMNS, *(["reactive_sensitivity"] if reactive else []))


def _flags(run: Column) -> Column:
    """What a reader of the verdict has to know; the steps themselves are in the table ``floored_steps``."""
    tested = F.col("v_lo.untestable")
    floored = lambda b, bound: F.when(run & (F.col(f"floored_{b}") > 0), F.concat(F.col(f"floored_{b}").cast("string"), F.lit(f" steps finish before they are ready at the {bound} bound; realised duration set to 0")))
    known = F.col("verdict").isin(*CLOCK_LABELS.values(), INSTITUTIONAL_LABEL, "Jointly binding", "Non-binding", "Indeterminate")
    return F.array_join(F.array_compact(F.array(
        floored("lo", "earliest"), floored("hi", "latest"), F.when(run & (F.col("finance_actionable") == "Not computable"), "finance slack not computable"),
        F.when(run & (F.col("sign_stable") == "Yes") & (F.col("engine_outcome") != "Indeterminate") & (F.size(tested) > 0), F.concat(F.lit("clocks without an ex-ante duration could not be tested: "), F.array_join(tested, ", "))),
        F.when(F.col("fragile") == "Yes", "fragile: decisive slack within one day of zero; report both bounds"), F.when(run & ~known, F.lit("no registered category for this verdict")))), "; ")


def floored_steps(moved: DataFrame) -> DataFrame:
    """``episode, step, bound``: steps on the path whose realised duration was negative and counts as 0."""
    at = lambda b, bound: F.when(F.col(f"early_{b}"), F.lit(bound))
    return moved.where("on_path").select("episode", "step", F.explode(F.array_compact(F.array(at("lo", "earliest"), at("hi", "latest")))).alias("bound"))


VERDICT_COLUMNS = ["episode", "verdict", "engine_outcome", "binding_clocks", "sign_stable", "indeterminate_reason", "reason", "decisive_slack_earliest", "decisive_slack_latest",
                   "baseline_slack_earliest", "baseline_slack_latest", "finance_slack_earliest", "finance_slack_latest", "finance_actionable", "fragile", "n_flags", "flags"]


def _reactive(t: DataFrame) -> DataFrame:
    """Whether the verdict of a binding episode stays when steps downstream of a corrected one are corrected too."""
    need = F.col("sign_stable").eqNullSafe("Yes") & ~F.col("verdict").isin("Non-binding", "Indeterminate")
    same = _same(F.col("w_lo"), F.col("v_lo")) & _same(F.col("w_hi"), F.col("v_hi"))
    changes = F.concat(F.lit("Changes to "), F.concat_ws(" ", F.col("w_lo.verdict"), F.when(F.size("w_lo.clocks") > 0, F.concat(F.lit("("), F.array_join("w_lo.clocks", "; "), F.lit(")")))))
    return t.withColumn("reactive_sensitivity", F.when(need, F.when(same, "Unchanged").otherwise(changes)).otherwise("Not applicable"))


@analysis("verdicts", "Critical-path verdicts", "Network")
def verdicts(episodes: DataFrame, steps: DataFrame, zero_as_documented: bool = False, institutional: bool = False, merge_institutional: bool = False, reactive: bool = True) -> Result:
    """Verdict per episode, orphan steps included, with the input problems and notes."""
    labels, synonyms = clock_set(institutional, merge_institutional)
    ep, st, problems, notes = read_episodes(episodes, steps, labels, synonyms, zero_as_documented)
    table = evaluate(ep, st, problems, notes, labels, reactive)
    orphans = st.select("episode").distinct().join(ep, "episode", "left_anti")
    lost = orphans.select("episode", F.lit("Indeterminate").alias("verdict"), F.lit("listed in the steps but not in the episodes").alias("reason"))
    once = ep.groupBy("episode").agg(*[F.min(c).alias(c) for c in ep.columns if c != "episode"])
    floored = floored_steps(propagate(once, st, sorted(labels), finishes=False))
    return Result({"verdicts": table.unionByName(lost, allowMissingColumns=True), "problems": problems, "notes": notes, "floored_steps": floored})


def zero_rule_sensitivity(episodes: DataFrame, steps: DataFrame) -> Result:
    """Verdicts under the registered treatment of zero durations and with every zero accepted."""
    a = verdicts(episodes, steps, reactive=False)["verdicts"]
    b = verdicts(episodes, steps, zero_as_documented=True, reactive=False)["verdicts"]
    m = a.select("episode", F.col("verdict").alias("registered"), F.col("indeterminate_reason").alias("r_a")).join(
        b.select("episode", F.col("verdict").alias("every_zero"), F.col("indeterminate_reason").alias("r_b")), "episode", "full_outer")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    m = materialize(m.withColumn("changed", ~F.col("registered").eqNullSafe(F.col("every_zero")) | (blank("r_a") != blank("r_b"))), "zero_rule")
    one = lambda c: m.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("verdict")).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    s = one("registered").join(one("every_zero"), "verdict", "full_outer").fillna(0)
    changed = m.agg(F.lit("episodes that change").alias("verdict"), F.lit(None).cast("long").alias("n_registered"), F.count_if("changed").alias("n_every_zero"))
    return Result({"summary": s.unionByName(changed), "episodes": m.select("episode", "registered", "every_zero", "changed")})


#: Rows that the corners of a block are laid out in at a time.
CORNER_ROWS = 200_000


def _outcome_keys(slack: np.ndarray, on: np.ndarray, gap: np.ndarray, n_clocks: int) -> np.ndarray:
    """Numbers that are equal where verdict and clocks of :func:`_verdict` are; ``on`` and ``gap`` are the clocks of the path and the untestable ones as bits."""
    ok, zero = slack >= -EPS, np.zeros(len(slack), np.int64)
    testable = [((on & ~gap) >> i) & 1 == 1 for i in range(n_clocks)]
    singles = sum(((testable[i] & ok[:, 1 + i]).astype(np.int64) << i for i in range(n_clocks)), zero)
    pairs = sum(((testable[i] & testable[j] & ok[:, 1 + n_clocks + m]).astype(np.int64) << m for m, (i, j) in enumerate(combinations(range(n_clocks), 2))), zero)
    kind = np.select([ok[:, 0], singles > 0, gap > 0, pairs > 0, (np.bitwise_count(on) > 2) & ok[:, -1]], [0, 1, 2, 3, 4], 5)
    return kind.astype(np.int64) << 32 | np.select([kind == 1, kind == 3, kind == 4], [singles, pairs, on], 0)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of some runs."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _corner_batch(rows: pa.Table, masks: np.ndarray, n_clocks: int, limit: int) -> pa.RecordBatch:
    """Interval dates of each episode of a block, and how many outcomes its corners have; the corners themselves stay arrays of the task."""
    b = _Block(rows, None, [])
    at = _runs(b.eid)
    size = np.diff(np.r_[at, b.n])
    count, some = lambda x: np.add.reduceat(x.astype(np.int64), at), lambda x: np.logical_or.reduceat(x, at)
    bits = lambda x: np.bitwise_or.reduceat(np.where(x, b.own, 0), at)
    wide = lambda x: np.abs(x[:, 1] - x[:, 0]) > EPS
    varies, va, vt = b.on & wide(b.done), wide(b.anchor[at]), wide(b.tw[at])
    n = count(varies) + va + vt
    pos = np.cumsum(varies) - 1
    pos -= np.repeat(pos[at] - varies[at] + 1, size) - np.repeat(va.astype(np.int64) + vt, size)
    on, gap, goal = bits(b.on), bits(b.on & np.isnan(b.exp)), np.minimum.reduceat(np.where(b.goal, np.arange(b.n), b.n), at) - at
    # an episode that is halted for its inputs is halted at every corner
    runs = ~some(b.twice) & some(b.is_goal) & ~some(b.level < 0) & ~np.isnan(b.tw[at, 0]) & ~np.isnan(b.anchor[at, 0]) & (count(b.on & np.isnan(b.done[:, 0])) == 0)
    todo = np.flatnonzero(runs & (n > 0) & (n <= limit))
    e_at = np.searchsorted(b.dst, at)
    e_size = np.diff(np.r_[e_at, len(b.dst)])
    ep = np.repeat(todo, 1 << n[todo])
    corner = _within(1 << n[todo])

    def keys(ep: np.ndarray, corner: np.ndarray) -> np.ndarray:
        off = np.cumsum(size[ep]) - size[ep]
        cid = np.repeat(np.arange(len(ep)), size[ep])
        base = at[ep][cid] + _within(size[ep])
        high = varies[base] & ((corner[cid] >> np.maximum(pos[base], 0)) & 1 == 1)
        done = np.where(high, b.done[base, 1], b.done[base, 0])[:, None]
        anchor = np.where(va[ep] & (corner & 1 == 1), b.anchor[at[ep], 1], b.anchor[at[ep], 0])
        tw = np.where(vt[ep] & ((corner >> va[ep]) & 1 == 1), b.tw[at[ep], 1], b.tw[at[ep], 0])
        move, e = np.repeat(off - at[ep], e_size[ep]), np.repeat(e_at[ep], e_size[ep]) + _within(e_size[ep])
        src, dst = b.src[e] + move, b.dst[e] + move
        start = _begin(anchor[cid][:, None], done, b.root[base], src, dst)
        fin = _finishes(b.level[base], start, np.maximum(done - start, 0.0), b.exp[base], b.own[base], None, src, dst, masks)
        return _outcome_keys(tw[:, None] - fin[off + goal[ep]], on[ep], gap[ep], n_clocks)

    outcomes = np.ones(len(at), np.int64)
    if len(ep):
        # at least one corner at a time, and as many as there is room for
        cut = np.flatnonzero(np.diff(np.cumsum(size[ep]) // CORNER_ROWS, prepend=0))
        found = np.concatenate([keys(x, y) for x, y in zip(np.split(ep, cut), np.split(corner, cut)) if len(x)])
        order = np.lexsort((found, ep))
        new = np.r_[True, (ep[order][1:] != ep[order][:-1]) | (found[order][1:] != found[order][:-1])]
        outcomes[todo] = np.bincount(ep[order][new], minlength=len(at))[todo]
    return pa.RecordBatch.from_pydict({"episode": rows.column("episode").combine_chunks().take(pa.array(at)), "n": pa.array(n.astype(np.int32)), "outcomes": pa.array(outcomes)})


def _written_corners(once: DataFrame, steps: DataFrame, labels: Mapping[str, str], limit: int) -> DataFrame:
    """``episode, n, outcomes`` as in the blocks, with a row for every step of every corner: for episodes that no task should hold."""
    clocks = sorted(labels)
    # only dates on the path to the required step count
    on = materialize(propagate(once, steps, clocks, finishes=False).where("on_path").select("episode", "step"), "on_path")
    wide = lambda a, b: F.abs(F.col(b) - F.col(a)) > EPS
    st = steps.join(on.withColumn("on", F.lit(True)), ["episode", "step"], "left").withColumn("varies", F.coalesce(wide("f_lo", "f_hi") & F.col("on"), F.lit(False)))
    per = st.groupBy("episode").agg(F.count_if("varies").alias("n_steps"))
    ep = once.join(per, "episode").withColumns({"va": F.coalesce(wide("anchor_lo", "anchor_hi"), F.lit(False)), "vt": F.coalesce(wide("tw_lo", "tw_hi"), F.lit(False))})
    ep = materialize(ep.withColumn("n", (F.col("n_steps") + F.col("va").cast("int") + F.col("vt").cast("int")).cast("int")), "varying")
    todo = ep.where((F.col("n") > 0) & (F.col("n") <= limit))
    corners = todo.withColumn("corner", F.explode(F.expr("sequence(0, cast(pow(2, n) as int) - 1)")))
    bit = lambda pos: F.expr(f"shiftright(corner, {pos}) & 1") == 1
    cid = F.concat_ws("\u001f", "episode", "corner")
    a = F.when(F.col("va") & bit("0"), F.col("anchor_hi")).otherwise(F.col("anchor_lo"))
    t = F.when(F.col("vt") & bit("cast(va as int)"), F.col("tw_hi")).otherwise(F.col("tw_lo"))
    cep = corners.select(cid.alias("episode"), "r_step", a.alias("anchor_lo"), a.alias("anchor_hi"), t.alias("tw_lo"), t.alias("tw_hi"))
    # an episode that is expanded has at most `limit` interval dates, so numbering them is a short window
    few = st.join(todo.select("episode"), "episode", "left_semi")
    pos = few.where("varies").select("episode", "step", (F.row_number().over(W.partitionBy("episode").orderBy("step")) - 1).alias("pos"))
    cst = few.join(pos, ["episode", "step"], "left").join(corners.select("episode", "corner", (F.col("va").cast("int") + F.col("vt").cast("int")).alias("shift")), "episode")
    f = F.when(F.col("varies") & (F.expr("shiftright(corner, cast(shift + pos as int)) & 1") == 1), F.col("f_hi")).otherwise(F.col("f_lo"))
    cst = cst.select(cid.alias("episode"), "step", "clock", "preds", f.alias("f_lo"), f.alias("f_hi"), "expected")
    none = lambda name: small_table(once.sparkSession, [], f"episode string, {name} string")
    res = evaluate(cep, materialize(cst, "corner_steps"), none("problem"), none("note"), labels, reactive=False)
    keys = res.select(F.substring_index("episode", "\u001f", 1).alias("episode"), F.concat_ws("|", "engine_outcome", "binding_clocks").alias("k"))
    return ep.select("episode", "n").join(keys.groupBy("episode").agg(F.count_distinct("k").alias("outcomes")), "episode", "left").select("episode", "n", F.coalesce("outcomes", F.lit(1)).cast("long").alias("outcomes"))


def corner_check(episodes: DataFrame, steps: DataFrame, problems: DataFrame, notes: DataFrame, labels: Mapping[str, str], limit: int = 10, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Whether the verdict is the same at every combination of date bounds, for episodes with few interval dates.

    Every combination is an episode of its own, with exact dates, and is evaluated as such. Episodes of ordinary size are laid
    out and evaluated inside their block, so no row of a combination is written or shuffled; larger ones become rows.
    """
    clocks = sorted(labels)
    masks = np.array([_mask(s, clocks) for s in scenarios(clocks)], np.int64)
    once = episodes.groupBy("episode").agg(*[F.min(c).alias(c) for c in episodes.columns if c != "episode"])
    small, big = _split(steps, block_steps)
    per = _in_blocks(once, small, clocks, lambda t: _corner_batch(t, masks, len(clocks), limit), "episode string, n int, outcomes long")
    if big is not None:
        per = per.unionByName(_written_corners(once.join(big, "episode", "left_semi"), steps.join(big, "episode", "left_semi"), labels, limit))
    wide = lambda a, b: F.coalesce(F.abs(F.col(b) - F.col(a)) > EPS, F.lit(False)).cast("int")
    # an episode without steps is halted at every corner
    ep = once.join(per, "episode", "left").withColumns({"n": F.coalesce("n", wide("anchor_lo", "anchor_hi") + wide("tw_lo", "tw_hi")), "outcomes": F.coalesce("outcomes", F.lit(1))})
    text = (F.when(F.col("n") == 0, "No intervals (exact dates)").when(F.col("n") > limit, F.concat(F.lit("Not run ("), F.col("n").cast("string"), F.lit(f" interval dates > {limit})")))
            .when(F.col("outcomes") == 1, "Stable at every bound combination").otherwise(F.concat(F.lit("Varies across "), F.col("outcomes").cast("string"), F.lit(" outcomes"))))
    bad = problems.select("episode").distinct()
    return ep.join(bad, "episode", "left_anti").select("episode", "n", text.alias("corner_check"))


def step_status(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ex-ante status, revelation dates and source class of every step, and the problems found.

    A documented duration prevails over 'revealed'; 'revealed' without a date counts as undocumented.
    """
    names = ["ex_ante_status", "revealed_at", "actionable_from", "source_class", "direct_record", "expected_days"]
    d = steps.withColumns({n: F.lit(None).cast("string") for n in names if n not in steps.columns})
    d = d.withColumns({"episode": blank_to_null("episode"), "step": blank_to_null("step")}).where("episode is not null and step is not null")
    raw = F.lower(normalize_text("ex_ante_status"))
    known = alias_value("ex_ante_status", EX_ANTE_STATUS)
    valid = known.isin("documented", "revealed", "undocumented")
    has = blank_to_null("expected_days").isNotNull()
    declared = F.when((raw != "") & valid, known).otherwise(F.when(has, "documented").otherwise("undocumented"))
    rev = dates.days_of(d, "revealed_at")
    status = F.when((declared == "revealed") & has, "documented").when((declared == "revealed") & rev.isNull(), "undocumented").otherwise(declared)
    act = dates.days_of(d, "actionable_from")
    src = F.regexp_replace(F.lower(normalize_text("source_class")), "[_ ]", "-")
    direct = F.lower(normalize_text("direct_record"))
    t = d.withColumns({"_status": status, "_declared": declared, "_rev": rev, "_act": act})
    say = lambda x: F.concat(F.lit("step "), F.col("step"), F.lit(f": {x}"))
    probs = t.select("episode", F.explode(F.array_compact(F.array(
        F.when((raw != "") & ~valid, say("ex_ante_status is not documented, revealed or undocumented")),
        F.when((F.col("_declared") == "revealed") & has, say("documented duration prevails over revealed")),
        F.when((F.col("_declared") == "revealed") & ~has & F.col("_rev").isNull(), say("revealed needs a revealed_at date; treated as undocumented")),
        F.when((F.col("_status") == "revealed") & F.col("_act").isNull(), say("no documented actionable_from, best case not computed")),
        F.when((src != "") & ~src.isin(*SOURCE_CLASSES), say("unknown source_class")),
    ))).alias("problem"))
    meta = t.select("episode", "step", F.col("_status").alias("status"), F.when(F.col("_status") == "revealed", F.col("_rev")).alias("revealed_at"), F.when(F.col("_status") == "revealed", F.col("_act")).alias("actionable_from"),
                    F.when(src.isin(*SOURCE_CLASSES), src).otherwise("").alias("source_class"), F.when(direct != "", direct.isin(*YES)).alias("direct_record"))
    return meta, probs


@analysis("verdicts_v4", "Critical-path verdicts with revelation bounds", "Network")
def verdicts_v4(episodes: DataFrame, steps: DataFrame, zero_as_documented: bool = False, merge_institutional: bool = False) -> Result:
    """Six-clock verdicts. A requirement revealed in process is bounded by a best case (known from the start) and a worst case (no expected duration)."""
    labels, synonyms = clock_set(True, merge_institutional)
    ep, st, problems, notes = read_episodes(episodes, steps, labels, synonyms, zero_as_documented)
    problems = materialize(problems, "problems")
    meta, extra = step_status(steps)
    meta = materialize(meta, "meta")
    revealed = meta.where("status = 'revealed'")
    worst = st.join(revealed.select("episode", "step", F.lit(True).alias("rv")), ["episode", "step"], "left").withColumn("expected", F.when(F.col("rv").isNull(), F.col("expected"))).drop("rv")
    w = materialize(evaluate(ep, worst, problems, notes, labels, reactive=False), "worst")
    # best case: start at the later of readiness and actionability, then the execution time after revelation
    has_rev = revealed.select("episode").distinct()
    rev_ep = ep.dropDuplicates(["episode"]).join(has_rev, "episode", "left_semi")
    rev_st = st.join(has_rev, "episode", "left_semi")
    reach = propagate(rev_ep, rev_st, sorted(labels), finishes=False).where("on_path")
    real = reach.select("episode", "step", "f_lo", "f_hi", *[F.coalesce(f"real_{b}", F.lit(0.0)).alias(f"real_{b}") for b in ("lo", "hi")])
    r = real.join(revealed.select("episode", "step", "revealed_at", "actionable_from"), ["episode", "step"])
    ready = lambda b: F.col(f"f_{b}") - F.col(f"real_{b}")
    cand = lambda b: F.greatest(F.col("actionable_from") - ready(b), F.lit(0.0)) + F.greatest(F.col(f"f_{b}") - F.greatest(ready(b), F.col("revealed_at")), F.lit(0.0))
    best_exp = materialize(r.select("episode", "step", F.when(F.col("actionable_from").isNotNull(), F.least(cand("lo"), cand("hi"))).alias("best"), F.lit(True).alias("is_rev")), "best")
    blocked = best_exp.where("best is null").select("episode").distinct()
    doable = has_rev.join(blocked, "episode", "left_anti")
    b_steps = st.join(doable, "episode", "left_semi").join(best_exp, ["episode", "step"], "left").withColumn("expected", F.when(F.col("is_rev"), F.col("best")).otherwise(F.col("expected"))).drop("best", "is_rev")
    b_steps = materialize(b_steps, "best_steps")
    b = evaluate(ep.join(doable, "episode", "left_semi"), b_steps, problems.join(doable, "episode", "left_semi"), notes, labels, reactive=False)
    m = w.join(b.select("episode", F.col("verdict").alias("b_verdict"), F.col("binding_clocks").alias("b_clocks")), "episode", "left").join(
        has_rev.withColumn("has_rev", F.lit(True)), "episode", "left")
    differs = F.col("b_verdict").isNotNull() & ~((F.col("b_verdict") == F.col("verdict")) & (F.col("b_clocks") == F.col("binding_clocks")))
    kind = (F.when(F.col("has_rev").isNull(), "Not applicable").when(F.col("b_verdict").isNull(), "Best case not computable; worst-case verdict reported")
            .when(differs, "Different (revelation-sensitive)").otherwise("Same verdict under best and worst case"))
    m = m.withColumns({"revelation_bounds": kind, "w_verdict": F.col("verdict")})
    m = m.withColumns({"verdict": F.when(differs, "Indeterminate").otherwise(F.col("verdict")), "binding_clocks": F.when(differs, "").otherwise(F.col("binding_clocks")),
                       "indeterminate_reason": F.when(differs, "revelation-sensitive").otherwise(F.col("indeterminate_reason"))})
    m = materialize(m.select("episode", "verdict", "binding_clocks", "sign_stable", "indeterminate_reason", "revelation_bounds", "finance_actionable", "fragile", "decisive_slack_earliest", "decisive_slack_latest"), "v4")
    cap = claim_cap(m, ep, st, meta, labels)
    yes = F.lower(normalize_text("related_party")) if "related_party" in episodes.columns else F.lit("")
    rel = episodes.select(blank_to_null("episode").alias("episode"), F.when(yes == "", "").when(yes.isin(*YES), "Yes").otherwise("No").alias("related_party")).where("episode is not null").groupBy("episode").agg(F.max("related_party").alias("related_party"))  # Yes if any row of the episode says so
    out = m.join(cap, "episode", "left").join(rel, "episode", "left").fillna("", ["claim_cap", "related_party"])
    return Result({"verdicts": out, "problems": problems.unionByName(extra), "notes": notes})


def claim_cap(verdict_rows: DataFrame, episodes: DataFrame, steps: DataFrame, meta: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Binding clocks whose steps on the path have no direct record by a non-internal source."""
    binding = [*labels.values(), "Jointly binding"]
    need = verdict_rows.where(F.col("verdict").isin(*binding)).select("episode", F.explode(F.array_distinct(F.transform(F.split("binding_clocks", "[;+]"), lambda x: F.trim(x)))).alias("clock")).where("clock <> ''")
    ep = episodes.dropDuplicates(["episode"]).join(need.select("episode").distinct(), "episode", "left_semi")
    moved = propagate(ep, steps.join(ep.select("episode"), "episode", "left_semi"), sorted(labels), finishes=False).where("on_path").select("episode", "step", "clock")
    ok = (F.col("source_class") != "") & (F.col("source_class") != "internal") & F.coalesce(F.col("direct_record"), F.lit(False))
    have = moved.join(meta, ["episode", "step"]).where(ok).select("episode", "clock").distinct().withColumn("ok", F.lit(True))
    j = need.join(have, ["episode", "clock"], "left")
    lacking = F.array_sort(F.collect_set(F.when(F.col("ok").isNull(), F.col("clock"))))  # at most one entry per clock
    g = j.groupBy("episode").agg(lacking.alias("lacking"))
    return g.select("episode", F.when(F.size("lacking") > 0, F.concat(F.lit("consistent with (internal evidence only for: "), F.array_join("lacking", ", "), F.lit(")"))).otherwise("not capped").alias("claim_cap"))


def exclude_related(episodes: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sensitivity: drop the episodes of related parties, with their steps."""
    rel = F.coalesce(F.lower(normalize_text("related_party")).isin(*YES), F.lit(False))
    drop = episodes.where(rel).select(blank_to_null("episode").alias("episode")).where("episode is not null").distinct()
    return episodes.where(~rel), steps.join(drop, F.trim(steps["episode"].cast("string")) == drop["episode"], "left_anti")


def concordance(study1: DataFrame, study2: DataFrame) -> Result:
    """Cross-tabulation of two studies' verdicts and a provisional attribution of every change."""
    a = study1.select("episode", F.col("verdict").alias("v1"))
    b = study2.select("episode", F.col("verdict").alias("v2"), F.col("binding_clocks").alias("c2"), F.col("indeterminate_reason").alias("r2"))
    m = a.join(b, "episode", "full_outer")
    changed = ~F.coalesce("v1", F.lit("(absent)")).eqNullSafe(F.coalesce("v2", F.lit("(absent)")))
    why = (F.when(~changed, "").when(F.col("v1").isNull() | F.col("v2").isNull(), "present in one study only").when(F.col("r2") == "revelation-sensitive", "revealed-in-process rule")
           .when(F.coalesce(F.col("c2"), F.lit("")).contains("institutional") | (F.col("v2") == INSTITUTIONAL_LABEL), "institutional clock separated from logistics").otherwise("re-coded inputs"))
    m = m.select("episode", "v1", "v2", changed.alias("changed"), why.alias("attribution"))
    tab = m.groupBy(F.coalesce("v1", F.lit("(absent)")).alias("study1"), F.coalesce("v2", F.lit("(absent)")).alias("study2")).agg(F.count(F.lit(1)).alias("episodes"))
    return Result({"episodes": m, "crosstab": tab})


def layer_summary(layers: DataFrame) -> Result:
    """Counts by layer and state over all layers and states, and the problems found."""
    require(layers, ["episode", "layer", "state"])
    d = layers if "evidence" in layers.columns else layers.withColumn("evidence", F.lit(None).cast("string"))
    d = d.select(blank_to_null("episode").alias("episode"), F.regexp_replace(F.lower(normalize_text("layer")), " ", "-").alias("layer"), F.lower(normalize_text("state")).alias("raw"), blank_to_null("evidence").alias("evidence")).where("episode is not null")
    d = d.withColumn("state", F.when(F.col("raw").isin(*LAYER_STATES), alias_value("raw", LAYER_STATES)))
    ok_layer = F.col("layer").isin(*LAYERS)
    kind = (F.when(~ok_layer, F.concat(F.lit("unknown layer "), "layer")).when(F.col("state").isNull(), F.concat(F.lit("unknown state "), "raw"))
            .when((F.col("state") == "Activated") & F.col("evidence").isNull(), F.lit("Activated needs an evidence reference")))
    probs = d.where(kind.isNotNull()).select("episode", kind.alias("problem"))
    good = d.where(ok_layer & F.col("state").isNotNull())
    dup = good.groupBy("episode", "layer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("episode", F.concat(F.lit("coded more than once: "), "layer").alias("problem"))
    states = list(dict.fromkeys(LAYER_STATES.values()))
    counts = good.groupBy("layer").agg(*[F.count_if(F.col("state") == s).alias(s.lower().replace(" ", "_")) for s in states])
    frame = small_table(layers.sparkSession, list(enumerate(LAYERS)), "position int, layer string")
    return Result({"counts": frame.join(counts, "layer", "left").fillna(0), "problems": probs.unionByName(dup)})


# Words in a column name that mark an interpretation a blind coder must not see.
INTERPRETATION_WORDS = (
    "verdict", "level", "gate", "claim", "tier", "reason", "flag", "outcome", "binding", "slack",
    "actionable", "sensitivity", "note", "interpret", "author", "fragile", "stable", "override", "pass", "result",
)


def blind_packet(tables: Mapping[str, DataFrame], key: str, seed: int, words: Sequence[str] = INTERPRETATION_WORDS) -> Result:
    """Tables without interpretation columns and with ids replaced by random codes; rows without an id keep a null one; the key table stays with the owner."""
    ids = reduce(DataFrame.unionByName, [t.select(F.trim(F.col(key).cast("string")).alias("id")) for t in tables.values()]).where("id <> ''").distinct()
    # the code is a keyed hash in base 36; two ids can only clash with probability near 2^-64 times the number of pairs
    code = F.concat(F.lit("U"), F.conv(F.hex(F.xxhash64(F.lit(seed), "id")), 16, 36))
    keys = materialize(ids.withColumn("code", code), "blind_keys")
    out = {}
    for name, t in tables.items():
        keep = [c for c in t.columns if c != key and not any(w in c.lower() for w in words)]
        out[name] = t.withColumn("_id", F.trim(F.col(key).cast("string"))).join(keys, F.col("_id") == F.col("id"), "left").select(F.col("code").alias(key), *keep)
    return Result({**out, "key": keys})


def timeline_intervals(episodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Ready and finish of every step in days after the anchor, with the uncertainty of its finish."""
    real = realised_durations(episodes, steps)
    rel = lambda c, a="anchor_lo": F.col(c) - F.col(a)
    return real.select("episode", "step", "clock", rel("ready_lo").alias("ready_day"), rel("f_lo").alias("finish_day"), rel("f_hi").alias("finish_day_latest"), (F.col("f_hi") - F.col("f_lo")).alias("uncertainty_days"), "expected")
