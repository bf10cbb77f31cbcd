"""Agreement between raters from contingency counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions.columns import as_list, require
from tallyspark.operators.describe import unpivot_text
from tallyspark.registry import Result, analysis
from tallyspark.runtime import small_table


def _scale_table(df: DataFrame, scale: Sequence[str]) -> DataFrame:
    return small_table(df.sparkSession, list(enumerate(scale)), "pos int, cat string")


def agreement_statistics(cells: DataFrame, keys: Sequence[str] = (), scale: Sequence[str] | None = None) -> DataFrame:
    """Percent agreement, kappa (plain, linear, quadratic) and AC1 per key from cell counts ``(keys, x, y, n)``.

    Categories are the given scale followed by other observed values, or the observed values in text order.
    Everything here works on the q x q counts.
    """
    keys = list(keys)
    seen = cells.select(*keys, F.col("x").alias("cat")).union(cells.select(*keys, F.col("y").alias("cat"))).distinct()
    if scale:
        base = _scale_table(cells, scale).select("cat", F.col("pos").alias("given"))
        full = cells.select(*keys).distinct().join(F.broadcast(base), F.lit(True)) if keys else base
        cats = full.join(seen, [*keys, "cat"], "full_outer")
    else:
        cats = seen.withColumn("given", F.lit(None).cast("int"))
    part = W.partitionBy(*(keys or [F.lit(0)]))
    cats = cats.withColumn("pos", F.row_number().over(part.orderBy(F.col("given").asc_nulls_last(), "cat")) - 1).withColumn("q", F.count(F.lit(1)).over(part)).drop("given")
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    on = keys or None
    px = cells.groupBy(*keys, F.col("x").alias("cat")).agg(F.sum("n").alias("nx"))
    py = cells.groupBy(*keys, F.col("y").alias("cat")).agg(F.sum("n").alias("ny"))
    marg = cats.join(px, [*keys, "cat"], "left").join(py, [*keys, "cat"], "left")
    marg = marg.join(total, on) if keys else marg.join(total, F.lit(True))
    marg = marg.withColumns({"px": F.coalesce("nx", F.lit(0)) / F.col("total"), "py": F.coalesce("ny", F.lit(0)) / F.col("total")}).drop("nx", "ny")
    pi = (F.col("px") + F.col("py")) / 2
    m = marg.groupBy(*keys, "q", "total").agg(
        F.sum(F.col("px") * F.col("py")).alias("pe"), F.sum(pi * (1 - pi)).alias("gini"))
    # expected disagreement under independence for each weighting: q x q rows
    a = marg.select(*keys, F.col("pos").alias("i"), "px", "q")
    b = marg.select(*keys, F.col("pos").alias("j"), "py")
    grid = a.join(b, on) if keys else a.join(b, F.lit(True))
    gap = F.try_divide(F.abs(F.col("i") - F.col("j")), F.col("q") - 1)
    exp = grid.groupBy(*keys).agg(F.sum(gap * F.col("px") * F.col("py")).alias("e1"), F.sum(gap * gap * F.col("px") * F.col("py")).alias("e2"))
    obs = cells.join(cats.select(*keys, F.col("cat").alias("x"), F.col("pos").alias("i"), "q"), [*keys, "x"]).join(
        cats.select(*keys, F.col("cat").alias("y"), F.col("pos").alias("j")), [*keys, "y"])
    o = obs.groupBy(*keys).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("same"), F.sum(gap * F.col("n")).alias("o1"), F.sum(gap * gap * F.col("n")).alias("o2"))
    t = m.join(exp, on).join(o, on) if keys else m.join(exp, F.lit(True)).join(o, F.lit(True))
    po = F.col("same") / F.col("total")
    pe1 = F.try_divide(F.col("gini"), F.col("q") - 1)
    return t.select(
        *keys, F.col("total").alias("n"), (100 * po).alias("percent_agreement"),
        F.when(F.col("pe") < 1, (po - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"),
        (1 - F.try_divide(F.col("o1") / F.col("total"), F.col("e1"))).alias("kappa_linear"),
        (1 - F.try_divide(F.col("o2") / F.col("total"), F.col("e2"))).alias("kappa_quadratic"),
        F.when((F.col("q") > 1) & (pe1 < 1), (po - pe1) / (1 - pe1)).alias("ac1"))


@analysis("agreement", "Rater agreement", "Scale")
def agreement(df: DataFrame, rater1: str, rater2: str, ordered: bool = False, categories=None) -> Result:
    """Percent agreement, kappa, weighted kappa and AC1, the confusion table, and a small-sample flag."""
    require(df, [rater1, rater2])
    cells = df.where(F.col(rater1).isNotNull() & F.col(rater2).isNotNull()).groupBy(
        F.col(rater1).cast("string").alias("x"), F.col(rater2).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    stats = agreement_statistics(cells, scale=as_list(categories) or None).withColumn("few_units", F.col("n") < 30)
    return Result({"statistics": stats if ordered else stats.drop("kappa_linear", "kappa_quadratic"),
                   "confusion": cells.select(F.col("x").alias("rater1"), F.col("y").alias("rater2"), "n")})


def agreement_with_primary(df: DataFrame, rater1: str, rater2: str, positive: str = "Yes") -> DataFrame:
    """Agreement on non-blank pairs, with the registered choice of statistic by prevalence of the positive value."""
    x, y = F.trim(F.coalesce(F.col(rater1).cast("string"), F.lit(""))), F.trim(F.coalesce(F.col(rater2).cast("string"), F.lit("")))
    cells = df.select(x.alias("x"), y.alias("y")).where("x <> '' and y <> ''").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    prev = cells.agg((F.sum(F.when(F.col("x") == positive, F.col("n")).otherwise(0)) / F.sum("n")).alias("prevalence"))
    s = agreement_statistics(cells).join(prev, F.lit(True))
    primary = F.when((F.col("prevalence") > 0.8) | (F.col("prevalence") < 0.2), "AC1").otherwise("kappa")
    return s.select("n", (F.col("percent_agreement") / 100).alias("raw_agreement"), "kappa", "ac1", "prevalence", primary.alias("primary_statistic"))


@analysis("krippendorff_alpha", "Krippendorff's alpha", "Scale")
def krippendorff_alpha(df: DataFrame, coders, by: str | None = None, unit: str | None = None) -> Result:
    """Nominal alpha over units with at least two values, raw agreement of complete units, disagreement table."""
    cs = as_list(coders)
    require(df, cs + ([by] if by else []))
    clean = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    family = F.coalesce(F.col(by).cast("string"), F.lit(None)) if by else F.lit("all items")
    d = df.select(family.alias("family"), *[clean(c).alias(f"c{i}") for i, c in enumerate(cs)])
    if by:
        d = d.where(F.col("family").isNotNull())
    vals = F.array_compact(F.array(*[F.col(f"c{i}") for i in range(len(cs))]))
    # a unit's contribution depends only on its row of codes: identical rows are counted first
    rows = d.groupBy("family", *[f"c{i}" for i in range(len(cs))]).agg(F.count(F.lit(1)).alias("units")).withColumn("vals", vals)
    pair = rows.where(F.size("vals") >= 2).select("family", "units", "vals", F.size("vals").alias("m"), F.explode("vals").alias("a"))
    same = F.size(F.filter("vals", lambda v: v == F.col("a")))
    # value a meets (m - 1) partners, weight 1/(m - 1) each; (same - 1) of them are equal
    per_cat = pair.groupBy("family", "a").agg(F.sum("units").alias("n_c"), F.sum(F.col("units") * (F.col("m") - same) / (F.col("m") - 1)).alias("differing"))
    coin = per_cat.groupBy("family").agg(F.sum("n_c").alias("n"), F.sum(F.col("n_c").cast("double") * F.col("n_c")).alias("sq"), F.sum("differing").alias("diff"))
    n = F.col("n").cast("double")
    d_o, d_e = F.col("diff") / n, F.try_divide(n * n - F.col("sq"), n * (n - 1))
    alpha = F.when(n > 1, F.when(d_e == 0, F.when(d_o == 0, 1.0)).otherwise(1 - d_o / d_e))
    full = F.size("vals") == len(cs)
    raw = rows.groupBy("family").agg(
        F.sum("units").alias("units"),
        F.try_divide(F.sum(F.when(full & (F.size(F.array_distinct("vals")) == 1), F.col("units")).otherwise(0)), F.sum(F.when(full, F.col("units")).otherwise(0))).alias("raw_agreement"))
    out = {"alpha": raw.join(coin, "family", "left").select("family", "units", alpha.alias("alpha"), "raw_agreement")}
    if len(cs) >= 2:
        out["disagreement"] = rows.groupBy("family", F.coalesce("c0", F.lit("(missing)")).alias("first"), F.coalesce("c1", F.lit("(missing)")).alias("second")).agg(F.sum("units").alias("n"))
    out["units_in_disagreement"] = rows.where(F.size(F.array_distinct("vals")) > 1).groupBy("family").agg(F.sum("units").alias("units"))
    return Result(out)


def kappa_bootstrap(cells: DataFrame, keys: Sequence[str], scale: Mapping[str, Sequence[str]] | None = None, replicates: int = 2000, seed: int = 20261004) -> DataFrame:
    """Percentile intervals of kappa and AC1 per key.

    Both statistics depend only on the q x q cell counts, so resampling units is a multinomial
    draw over the cells of a key; keys are columns of a rule file and have few cells each.
    """
    keys = list(keys)
    scales = {k: list(v) for k, v in (scale or {}).items()}
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "n")).alias("cells"))
    schema = ", ".join(f"`{k}` string" for k in keys) + ", kappa_low double, kappa_high double, ac1_low double, ac1_high double"

    def draw(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                cs = sorted((c["x"], c["y"], int(c["n"])) for c in rec["cells"])
                name = str(rec[keys[-1]])
                cats = list(dict.fromkeys([*scales.get(name, []), *sorted({v for c in cs for v in c[:2]})]))
                ix, iy = (np.array([cats.index(c[s]) for c in cs]) for s in (0, 1))
                n = np.array([c[2] for c in cs])
                total, q = n.sum(), len(cats)
                lim = [None] * 4
                if total >= 5:
                    rng = np.random.default_rng([seed, *map(ord, name)])
                    p = rng.multinomial(total, n / total, size=replicates) / total
                    po = p[:, ix == iy].sum(axis=1)
                    px, py = np.zeros((replicates, q)), np.zeros((replicates, q))
                    for c in range(len(cs)):
                        px[:, ix[c]] += p[:, c]
                        py[:, iy[c]] += p[:, c]
                    pi = (px + py) / 2
                    with np.errstate(all="ignore"):
                        pe = (px * py).sum(axis=1)
                        kap = np.where(pe < 1, (po - pe) / (1 - pe), np.nan)
                        g = (pi * (1 - pi)).sum(axis=1) / (q - 1) if q > 1 else np.full(replicates, np.nan)
                        ac = np.where(g < 1, (po - g) / (1 - g), np.nan)
                    for j, v in enumerate((kap, ac)):
                        v = v[~np.isnan(v)]
                        if len(v) > replicates / 2:
                            lim[2 * j], lim[2 * j + 1] = map(float, np.percentile(v, [2.5, 97.5]))
                rows.append([*(str(rec[k]) for k in keys), *lim])
            yield pd.DataFrame(rows, columns=[*keys, "kappa_low", "kappa_high", "ac1_low", "ac1_high"])

    return packed.mapInPandas(draw, schema)


def table_agreement(a: DataFrame, b: DataFrame, key: str, columns, scales: Mapping[str, Sequence[str]] | None = None, replicates: int = 2000, seed: int = 20261004) -> Result:
    """Column-by-column agreement of two coded tables on their common units, disagreements, and units in one table only."""
    cols = as_list(columns)
    low = lambda d: d.withColumn("unit", F.lower(F.trim(F.col(key).cast("string")))).where("unit <> ''")
    left, right = low(a), low(b)
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(c)
    la = unpivot_text(left, cols, ["unit"]).select("unit", F.col("variable").alias("column"), blank(F.col("level")).alias("x"))
    lb = unpivot_text(right, cols, ["unit"]).select("unit", F.col("variable").alias("column"), blank(F.col("level")).alias("y"))
    both = la.join(lb, ["unit", "column"])
    cells = both.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for name in cols:
        parts.append(agreement_statistics(cells.where(F.col("column") == name), ["column"], (scales or {}).get(name)))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    stats = stats.select("column", F.col("n").alias("units"), "percent_agreement", "kappa", "ac1")
    if replicates:
        stats = stats.join(kappa_bootstrap(cells, ["column"], scales, replicates, seed), "column", "left")
    ua, ub = left.select("unit").distinct(), right.select("unit").distinct()
    return Result({
        "agreement": stats,
        "disagreements": both.where("x <> y").select("unit", "column", F.col("x").alias("first"), F.col("y").alias("second")),
        "unmatched": ua.join(ub, "unit", "left_anti").withColumn("only_in", F.lit("first")).unionByName(ub.join(ua, "unit", "left_anti").withColumn("only_in", F.lit("second"))),
    })


# Evidence levels from lowest to highest.
LEVEL_ORDER = ("Outside analytic archive", "Held at S0", "Below Level 1", "Level 1", "Level 2", "Level 3")


def level_agreement(a: DataFrame, b: DataFrame, key: str, level: str = "level", order: Sequence[str] = LEVEL_ORDER) -> DataFrame:
    """Linear-weighted kappa of computed levels, number of differing units, and overlap of the top level."""
    unit = F.lower(F.trim(F.col(key).cast("string")))
    m = a.select(unit.alias("unit"), F.coalesce(level, F.lit("")).alias("u")).join(b.select(unit.alias("unit"), F.coalesce(level, F.lit("")).alias("v")), "unit")

    def rank(c):
        out = F.lit(None).cast("int")
        for i, name in reversed(list(enumerate(order))):
            out = F.when((c == name) | c.startswith(name + " "), F.lit(i)).otherwise(out)
        return out

    k = len(order) - 1
    top = order[-1]
    cells = m.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).withColumns({"i": rank(F.col("u")), "j": rank(F.col("v"))})
    counts = cells.agg(
        F.sum("n").alias("units"), F.sum(F.when(F.col("u") != F.col("v"), F.col("n")).otherwise(0)).alias("differing"),
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for name, c in (
            ("top_first", F.col("u") == top), ("top_second", F.col("v") == top),
            ("top_both", (F.col("u") == top) & (F.col("v") == top)), ("top_either", (F.col("u") == top) | (F.col("v") == top)))])
    ok = cells.where("i is not null and j is not null")
    total = ok.agg(F.sum("n").alias("total"))
    mi = ok.groupBy("i").agg(F.sum("n").alias("ni"))
    mj = ok.groupBy("j").agg(F.sum("n").alias("nj"))
    w = 1 - F.abs(F.col("i") - F.col("j")) / k
    pe = mi.join(mj, F.lit(True)).join(total, F.lit(True)).agg(F.sum(w * F.col("ni") / F.col("total") * F.col("nj") / F.col("total")).alias("pe"))
    po = ok.join(total, F.lit(True)).agg(F.sum(w * F.col("n") / F.col("total")).alias("po"))
    return counts.join(po.join(pe, F.lit(True)), F.lit(True)).withColumn(
        "kappa_linear", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))).drop("po", "pe")
