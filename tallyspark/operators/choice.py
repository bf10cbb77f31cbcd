"""Discrete-choice models on long choice tables.

One row per alternative. The conditional-logit likelihood needs, per choice set, the sums of
exp(u), exp(u) x and exp(u) x x'; these are ordinary grouped sums, so a Newton step is a grouped
aggregation followed by a global one and sets of any size and any number of them work alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, number, require, text_levels
from tallyspark.operators.describe import frequencies
from tallyspark.operators.glm import MlFit, newton
from tallyspark.operators.linear import weighted_sum
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table

OUTSIDE = "__OUTSIDE__"

#: Rows (kinds of sets of a respondent) that a task of the mixed logit holds before it adds them up.
PANEL_ROWS = 40_000
#: Different alternatives (rows of terms) up to which sets are added up from them instead of row by row.
PATTERNS = 64


@dataclass
class Choice:
    """Expanded choice table: ``set_id``, ``respondent``, ``y``, terms ``x0``.. and the set's factor level ``grp``."""

    data: DataFrame
    terms: list[str]
    factor_levels: list[str]

    @property
    def columns(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.terms))]

    def subset(self, cond: Column) -> "Choice":
        return Choice(self.data.where(cond), self.terms, self.factor_levels)


def _sets(df: DataFrame, respondent: str, task: str) -> Column:
    return F.concat_ws("\u001f", F.col(respondent).cast("string"), F.col(task).cast("string"))


def prepare_choice(df: DataFrame, attributes, chosen: str, respondent: str, task: str = "task", alternative: str = "profile", baselines: Mapping[str, str] | None = None,
                   factor: str | None = None, factor_baseline: str | None = None, add_outside: bool = True) -> Choice:
    """Validated long choice data with an outside alternative for tasks in which nothing was chosen.

    Attributes become 0/1 terms against their baseline, the outside alternative has its own term, and a
    task-level factor enters through interactions only. Invalid data stops the run.
    """
    attrs = as_list(attributes)
    require(df, [respondent, task, alternative, chosen, *attrs, *([factor] if factor else [])])
    base = {str(k): str(v) for k, v in (baselines or {}).items()}
    d = df.select(F.col(respondent).cast("string").alias("respondent"), _sets(df, respondent, task).alias("set_id"), number(chosen).alias("y"),
                  *[F.col(a).cast("string").alias(f"a{i}") for i, a in enumerate(attrs)], *([F.col(factor).cast("string").alias("grp")] if factor else [F.lit("").alias("grp")]))
    d = materialize(d, "profiles")
    sets = materialize(d.groupBy("set_id").agg(F.min("respondent").alias("respondent"), F.min("grp").alias("grp"), F.sum("y").alias("picked"), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)).alias("bad")), "sets")
    chk = sets.agg(F.sum("bad").alias("bad"), F.count_if(F.col("picked") > 1).alias("many"), F.count_if(F.col("picked") == 0).alias("none")).first()
    if chk["bad"]:
        raise ValueError(f"{chosen!r} must contain only 0 and 1")
    if chk["many"]:
        raise ValueError(f"{chk['many']} choice sets have more than one chosen alternative")
    if chk["none"] and not add_outside:
        raise ValueError("some sets have no choice; use add_outside=True")
    levels = {a: text_levels(d, f"a{i}") for i, a in enumerate(attrs)}
    for a in attrs:
        base.setdefault(a, levels[a][0])
        if base[a] not in levels[a]:
            raise ValueError(f"baseline {base[a]!r} is not observed for {a!r}")
    long = d.withColumn("outside", F.lit(0.0))
    if add_outside:
        out = sets.select("respondent", "set_id", F.when(F.col("picked") == 0, 1.0).otherwise(0.0).alias("y"), *[F.lit(OUTSIDE).alias(f"a{i}") for i in range(len(attrs))], "grp", F.lit(1.0).alias("outside"))
        long = long.unionByName(out)
    terms: dict[str, Column] = {}
    for i, a in enumerate(attrs):
        for lv in levels[a]:
            if lv != base[a]:
                terms[f"{a}={lv}"] = F.when(F.col(f"a{i}") == lv, 1.0).otherwise(0.0)
    if add_outside:
        terms["outside"] = F.col("outside")
    flv: list[str] = []
    if factor:
        flv = text_levels(d, "grp")
        fb = str(factor_baseline) if factor_baseline else flv[0]
        if fb not in flv:
            raise ValueError(f"factor baseline {fb!r} is not observed")
        main = dict(terms)
        for lv in flv:
            if lv != fb:
                terms |= {f"{t} x {factor}={lv}": c * F.when(F.col("grp") == lv, 1.0).otherwise(0.0) for t, c in main.items()}
    data = long.select("set_id", "respondent", "grp", "y", *[c.alias(f"x{i}") for i, c in enumerate(terms.values())])
    return Choice(materialize(data, "choice"), list(terms), flv)


def _choice_sums(data: DataFrame, utility: Column, features: Sequence[Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """Conditional log-likelihood with its gradient and Gauss-Newton Hessian in the derivative features of the utility."""
    k = len(features)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    w = F.col("w") if "w" in data.columns else F.lit(1.0)  # how many equal sets this one stands for
    d = data.select("set_id", "y", utility.alias("u"), w.alias("w"), *[f.alias(f"f{i}") for i, f in enumerate(features)])
    # utilities relative to the set's largest: the likelihood is the same and no exponential overflows
    d = d.withColumn("u", F.col("u") - F.max("u").over(W.partitionBy("set_id")))
    e, f = F.exp("u"), [F.col(f"f{i}") for i in range(k)]
    per = d.groupBy("set_id").agg(
        F.first("w").alias("w"), F.sum(e).alias("den"), F.sum(F.col("y") * F.col("u")).alias("cu"), *[F.sum(F.col("y") * f[i]).alias(f"c{i}") for i in range(k)],
        *[F.sum(e * f[i]).alias(f"s{i}") for i in range(k)], *[F.sum(e * f[i] * f[j]).alias(f"q{i}_{j}") for i, j in upper])
    m = [F.col(f"s{i}") / F.col("den") for i in range(k)]
    r = per.agg(F.sum(F.col("w") * (F.col("cu") - F.log("den"))).alias("ll"), *[F.sum(F.col("w") * (F.col(f"c{i}") - m[i])).alias(f"g{i}") for i in range(k)],
                *[F.sum(F.col("w") * (m[i] * m[j] - F.col(f"q{i}_{j}") / F.col("den"))).alias(f"h{i}_{j}") for i, j in upper]).first()
    h = np.zeros((k, k))
    for i, j in upper:
        h[i, j] = h[j, i] = r[f"h{i}_{j}"]
    return float(r["ll"]), np.array([r[f"g{i}"] for i in range(k)], float), h


def equal_sets(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One set of every kind with the number ``w`` of sets that have the same rows, in whatever order.

    Terms are 0/1, so the kinds do not grow with the sets, and the steps of a fit run over kinds. Sets are told apart
    by two 64-bit sums of row hashes and their size.
    """
    row = [F.col("y"), *[F.col(c) for c in columns]]
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(20,0)"))
    kinds = data.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("m1"), mark(2).alias("m2")).groupBy("n", "m1", "m2").agg(F.min("set_id").alias("set_id"), F.count(F.lit(1)).cast("double").alias("w"))
    return data.join(materialize(kinds.select("set_id", "w"), "kinds"), "set_id")


def fit_mnl(choice: Choice) -> MlFit:
    """Conditional logit by maximum likelihood; the Hessian is exact."""
    # partitioned and sorted by set once, so that the steps group without another shuffle or sort
    data = equal_sets(choice.data.select("set_id", "y", *choice.columns), choice.columns).repartition("set_id").sortWithinPartitions("set_id").persist(StorageLevel.MEMORY_AND_DISK)
    x = [F.col(c) for c in choice.columns]
    try:
        return newton(lambda b: _choice_sums(data, weighted_sum(x, b), x), np.zeros(len(x)), max_iter=25)
    finally:
        data.unpersist()


def _table(spark, names: Sequence[str], fit: MlFit) -> DataFrame:
    se = np.sqrt(np.maximum(np.diag(fit.vcov), 0))
    rows = []
    for t, b, s in zip(names, fit.theta, se):
        z = b / s if s > 0 else float("nan")
        rows.append((t, float(b), float(s), float(z), float(2 * dist.norm_sf(abs(z))) if np.isfinite(z) else None, float(b - 1.96 * s), float(b + 1.96 * s)))
    return small_table(spark, rows, "term string, b double, se double, z double, p double, ci_low double, ci_high double")


@analysis("mnl", "Conditional logit", "Choice")
def mnl(df: DataFrame, attributes, chosen: str, respondent: str, task: str = "task", alternative: str = "profile", **kw) -> Result:
    c = prepare_choice(df, attributes, chosen, respondent, task, alternative, **kw)
    fit = fit_mnl(c)
    n = c.data.select("set_id").distinct().count()
    return Result({"coefficients": _table(df.sparkSession, c.terms, fit),
                   "model": small_table(df.sparkSession, [(n, fit.loglik, len(c.terms), fit.converged, fit.iterations)], "sets long, loglik double, parameters int, converged boolean, iterations int")})


@analysis("choice_diagnostics", "Choice diagnostics", "Choice")
def choice_diagnostics(df: DataFrame, attributes, chosen: str, respondent: str, task: str = "task", factor: str | None = None) -> Result:
    """Counts of respondents, tasks, rejected and invalid tasks; level shares; factor balance over tasks."""
    attrs = as_list(attributes)
    d = df.withColumns({"_set": _sets(df, respondent, task), "_y": number(chosen)})
    sets = d.groupBy("_set").agg(F.sum("_y").alias("picked"), *([F.min(F.col(factor).cast("string")).alias("f")] if factor else []))
    s = sets.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("picked") == 0).alias("rejected"), F.avg((F.col("picked") == 0).cast("double")).alias("reject_rate"), F.count_if(F.col("picked") > 1).alias("invalid"))
    r = d.agg(F.count_distinct(respondent).alias("respondents"), F.count(F.lit(1)).alias("profile_rows"))
    out = {"summary": r.join(s, F.lit(True)), "levels": frequencies(df, attrs).where("level <> 'Total'").select(F.col("variable").alias("attribute"), "level", "n", (F.col("percent") / 100).alias("share"))}
    if factor:
        out["factor"] = sets.groupBy(F.col("f").alias("factor_level")).agg(F.count(F.lit(1)).alias("tasks"))
    return Result(out)


@analysis("swait_louviere", "Scale and preference equality", "Choice")
def swait_louviere(df: DataFrame, attributes, chosen: str, respondent: str, task: str = "task", alternative: str = "profile", factor: str = "", baselines: Mapping[str, str] | None = None) -> Result:
    """Two groups of sets: separate models, common preferences with a free relative scale, and pooled; two likelihood-ratio tests."""
    c = prepare_choice(df.withColumn("_f", F.col(factor).cast("string")), attributes, chosen, respondent, task, alternative, baselines)
    groups = materialize(df.select(_sets(df, respondent, task).alias("set_id"), F.col(factor).cast("string").alias("g")).groupBy("set_id").agg(F.min("g").alias("g")), "groups")
    levels = text_levels(groups, "g")
    if len(levels) != 2:
        raise ValueError("the factor must have exactly two levels")
    data = materialize(c.data.join(groups, "set_id"), "two_groups")
    c = Choice(data, c.terms, levels)
    fa, fb, pooled = fit_mnl(c.subset(F.col("g") == levels[0])), fit_mnl(c.subset(F.col("g") == levels[1])), fit_mnl(c)
    k = len(c.terms)
    x = [F.col(n) for n in c.columns]
    second = F.when(F.col("g") == levels[1], 1.0).otherwise(0.0)
    held = data.repartition("set_id").persist(StorageLevel.MEMORY_AND_DISK)

    def evaluate(theta):
        scale = 1.0 + second * F.lit(float(np.exp(theta[k]) - 1.0))
        u = weighted_sum(x, theta[:k]) * scale
        return _choice_sums(held, u, [*[v * scale for v in x], second * u])

    start = np.concatenate([pooled.theta, [0.0]])
    common = newton(evaluate, start, max_iter=40)
    held.unpersist()
    sep = fa.loglik + fb.loglik
    lr_pref, df_pref = max(0.0, 2 * (sep - common.loglik)), max(k - 1, 1)
    lr_scale = max(0.0, 2 * (common.loglik - pooled.loglik))
    row = (levels[0], levels[1], float(np.exp(common.theta[k])), fa.loglik, fb.loglik, sep, common.loglik, pooled.loglik, lr_pref, df_pref, float(dist.chi2_sf([lr_pref], [float(df_pref)])[0]),
           lr_scale, 1, float(dist.chi2_sf([lr_scale], [1.0])[0]), all(f.converged for f in (fa, fb, pooled, common)))
    return Result({"test": small_table(df.sparkSession, [row], "group1 string, group2 string, relative_scale double, loglik_group1 double, loglik_group2 double, loglik_separate double, loglik_scaled double, loglik_pooled double, "
                                       "preference_lr double, preference_df int, preference_p double, scale_lr double, scale_df int, scale_p double, converged boolean")})


def panel_kinds(choice: Choice) -> DataFrame:
    """``respondent, kind, n``: how many sets of each kind a respondent has. A kind is its rows, in order: the choice and the terms as 0/1, joined by commas."""
    row = F.concat(*[F.when(F.col(c) == 1, "1").otherwise("0") for c in ("y", *choice.columns)])
    sets = choice.data.select("respondent", "set_id", row.alias("row")).groupBy("respondent", "set_id").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("kind"))
    return sets.groupBy("respondent", "kind").agg(F.count(F.lit(1)).alias("n"))


def halton_normal(n: int, dim: int, seed: int) -> np.ndarray:
    """Shifted Halton points as normal draws, centred per dimension."""
    rng = np.random.default_rng(seed)
    primes, p = [], 1
    while len(primes) < dim:
        p += 1
        if all(p % q for q in primes if q * q <= p):
            primes.append(p)
    out = np.empty((n, dim))
    for j, p in enumerate(primes):
        for i in range(n):
            f, r, m = 1.0, 0.0, i + 1
            while m:
                f /= p
                r += f * (m % p)
                m //= p
            out[i, j] = r
    u = np.clip((out + rng.random(dim)) % 1.0, 1e-10, 1 - 1e-10)
    z = dist.norm_ppf(u)
    return z - z.mean(axis=0, keepdims=True)


@analysis("mixed_logit", "Mixed logit", "Choice")
def mixed_logit(df: DataFrame, attributes, chosen: str, respondent: str, random_terms, task: str = "task", alternative: str = "profile", draws: int = 128, seed: int = 20260928, max_iter: int = 60, **kw) -> Result:
    """Normal random coefficients, the same draws for every respondent, panel product by respondent, simulated likelihood.

    Sets with the same rows have the same likelihood under a draw, so a task works these out once for the kinds of sets in
    front of it, and a respondent is the kinds of its sets with their numbers. Where the alternatives themselves are of few
    kinds, exponentials are taken of these only and sets are sums of them. Rows are ordered by respondent and streamed:
    a task holds some blocks of rows, up to ``PANEL_ROWS`` rows of a respondent that goes on and its running sums, so a
    respondent with very many sets needs no more memory.
    """
    c = prepare_choice(df, attributes, chosen, respondent, task, alternative, **kw)
    rand = as_list(random_terms)
    unknown = [t for t in rand if t not in c.terms]
    if unknown or not rand:
        raise ValueError(f"random terms not found: {unknown}; available: {c.terms}")
    if draws < 16:
        raise ValueError("use at least 16 draws")
    idx = [c.terms.index(t) for t in rand]
    k, q = len(c.terms), len(rand)
    z = halton_normal(draws, q, seed)
    base = fit_mnl(c)
    spark = df.sparkSession
    # in partitions that stay whole, as a respondent must not be cut between two tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    data = panel_kinds(c).repartition(parts, "respondent").sortWithinPartitions("respondent").persist(StorageLevel.MEMORY_AND_DISK)
    p = k + q

    def evaluate(theta):
        mean, sd = theta[:k], np.exp(theta[k:])

        def solve(block: pa.Table):
            """Which kind each row is, and the choices (0/1) and terms of all rows of the kinds with where each kind starts."""
            kind = block.column("kind").combine_chunks().dictionary_encode()
            names = kind.dictionary.to_pylist()
            rows = np.frombuffer((",".join(names) + ",").encode(), np.uint8).reshape(-1, k + 2)[:, : k + 1] - 48
            sizes = np.array([(len(x) + 1) // (k + 2) for x in names])
            return kind.indices.to_numpy(), rows[:, 0].astype(float), rows[:, 1:].astype(float), np.cumsum(sizes) - sizes, sizes

        def patterns(y, x, sizes):
            """The alternatives as few kinds of their own: their terms, exponentials by draw, how often each set has them, and what a set needs of them. None if they are many or far apart."""
            if k > 62:
                return None
            code, first, of = np.unique(x.astype(np.int64) @ (1 << np.arange(k)), return_index=True, return_inverse=True)
            if len(code) > PATTERNS:
                return None
            t = x[first]
            u = (t @ mean)[:, None] + t[:, idx] @ (sd[:, None] * z.T)
            u -= u.max(axis=0)
            if u.min() < -600:
                return None
            e = np.exp(u)
            cell = np.repeat(np.arange(len(sizes)), sizes) * len(code) + of
            table = lambda w: np.bincount(cell, w, len(sizes) * len(code)).reshape(len(sizes), len(code))
            has, taken = table(None).astype(float), table(y)
            den = has @ e
            return t, e, has, taken @ t, den, taken @ u - np.log(den)

        def direct(y, x, starts, sizes):
            """Log-likelihood of each kind (kinds x draws) and gradient (kinds x terms x draws)."""
            # utilities relative to the set's largest: no exponential overflows
            u = (x @ mean)[:, None] + x[:, idx] @ (sd[:, None] * z.T)
            u -= np.repeat(np.maximum.reduceat(u, starts), sizes, axis=0)
            e = np.exp(u)
            den = np.add.reduceat(e, starts)
            e /= np.repeat(den, sizes, axis=0)
            lp = np.add.reduceat(u * y[:, None], starts) - np.log(den)
            resid = y[:, None] - e
            grad = np.empty((len(sizes), p, draws))
            for j in range(k):
                grad[:, j] = np.add.reduceat(resid * x[:, [j]], starts)
            grad[:, k:] = grad[:, idx] * (sd[:, None] * z.T)
            return lp, grad

        def job(batches):
            total = np.zeros(1 + p + p * p)
            state = {"resp": None, "lp": None, "grad": None}

            def close():
                if state["resp"] is not None:
                    lp = state["lp"]
                    top = lp.max()
                    w = np.exp(lp - top)
                    g = state["grad"] @ (w / w.sum())
                    total[0] += top + np.log(w.mean())
                    total[1 : 1 + p] += g
                    total[1 + p :] -= np.outer(g, g).ravel()
                    state["resp"] = None

            def add(block: pa.Table):
                """Some sets of one respondent, whose sums over the draws are kept until it ends."""
                kind, y, x, starts, sizes = solve(block)
                n = np.bincount(kind, block.column("n").to_numpy(), minlength=len(sizes))
                few = patterns(y, x, sizes)
                if few is None:
                    lp, grad = direct(y, x, starts, sizes)
                    grad = np.tensordot(n, grad, 1)
                else:
                    t, e, has, chosen_terms, den, lp = few
                    grad = (n @ chosen_terms)[:, None] - t.T @ (e * ((has * n[:, None]).T @ (1 / den)))
                    grad = np.concatenate([grad, grad[idx] * (sd[:, None] * z.T)])
                who = block.column("respondent")[0].as_py()
                if who != state["resp"]:
                    close()
                    state.update(resp=who, lp=np.zeros(draws), grad=np.zeros((p, draws)))
                state["lp"] = state["lp"] + n @ lp
                state["grad"] = state["grad"] + grad

            def add_whole(block: pa.Table):
                """Whole respondents: their weights over the draws are known before the gradient, which then needs no sums by draw."""
                kind, y, x, starts, sizes = solve(block)
                n = block.column("n").to_numpy().astype(float)
                who = block.column("respondent").combine_chunks().dictionary_encode().indices.to_numpy()
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                size = np.diff(np.r_[first, len(who)])
                few = patterns(y, x, sizes)
                each, grad = direct(y, x, starts, sizes) if few is None else (few[-1], None)
                lp = np.zeros((len(first), draws))
                for i in range(size.max()):  # the i-th row of each respondent
                    m = np.flatnonzero(size > i)
                    r = first[m] + i
                    lp[m] += each[kind[r]] * n[r, None]
                top = lp.max(axis=1, keepdims=True)
                w = np.exp(lp - top)
                total[0] += float((top[:, 0] + np.log(w.mean(axis=1))).sum())
                w /= w.sum(axis=1, keepdims=True)
                of = np.repeat(np.arange(len(first)), size)
                g = np.empty((len(kind), p))
                if few is not None:
                    t, e, has, chosen_terms, den, _ = few
                    by_draw, wz = np.concatenate([e, *[e * z[:, i] for i in range(q)]]).T, w @ z
                for i in range(0, len(kind), 1_000):
                    at, o = kind[i : i + 1_000], of[i : i + 1_000]
                    if few is None:
                        g[i : i + 1_000] = np.einsum("rpd,rd->rp", grad[at], w[o])
                        continue
                    shares = ((w[o] / den[at]) @ by_draw).reshape(len(at), 1 + q, len(t)) * has[at][:, None]
                    g[i : i + 1_000, :k] = chosen_terms[at] - shares[:, 0] @ t
                    for m, j in enumerate(idx):
                        g[i : i + 1_000, k + m] = sd[m] * (chosen_terms[at, j] * wz[o, m] - shares[:, 1 + m] @ t[:, j])
                g = np.add.reduceat(g * n[:, None], first)
                total[1 : 1 + p] += g.sum(axis=0)
                total[1 + p :] -= (g.T @ g).ravel()

            def take(block: pa.Table, end: bool):
                """Adds up what is complete, and gives back the rows of the last respondent, who may go on in the next batch."""
                who = block.column("respondent")
                last = block.num_rows if end else pc.index(who, who[-1]).as_py()
                if state["resp"] is not None:
                    begun = int(pc.sum(pc.equal(who, state["resp"])).as_py() or 0)
                    if begun and last:
                        add(block.slice(0, begun))
                    if last:
                        close()
                        block, last = block.slice(begun), last - begun
                if last:
                    add_whole(block.slice(0, last))
                rest = block.slice(last)
                if rest.num_rows > PANEL_ROWS:
                    add(rest)
                    rest = rest.slice(rest.num_rows)
                return rest

            held = []
            for batch in batches:
                held.append(pa.Table.from_batches([batch]))
                if sum(t.num_rows for t in held) > PANEL_ROWS:
                    held = [take(pa.concat_tables(held), False)]
            block = pa.concat_tables(held) if held else None
            if block is not None and block.num_rows:
                take(block, True)
            close()
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(total)})

        s = np.zeros(1 + p + p * p)
        for r in data.mapInArrow(job, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            s[r["i"]] = r["v"]
        return float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)

    fit = newton(evaluate, np.concatenate([base.theta, np.log(np.full(q, 0.25))]), max_iter=max_iter, tol=1e-6,
                 valid=lambda t: bool((t[k:] < 10).all()))  # no pass over the data for deviations beyond any sense
    n = data.select("respondent").distinct().count()
    data.unpersist()
    sd = np.exp(fit.theta[k:])
    rows = [(t, float(fit.theta[i]), float(sd[idx.index(i)]) if i in idx else 0.0, i in idx) for i, t in enumerate(c.terms)]
    return Result({"coefficients": small_table(df.sparkSession, rows, "term string, mean double, random_sd double, random boolean"),
                   "model": small_table(df.sparkSession, [(n, fit.loglik, base.loglik, draws, fit.converged, fit.iterations)], "respondents long, loglik double, loglik_mnl double, draws int, converged boolean, iterations int")})
