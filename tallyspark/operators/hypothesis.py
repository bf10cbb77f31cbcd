"""t-tests, one-way ANOVA with Tukey comparisons, Fisher's exact test, Wilson intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, numeric, require, text_levels
from tallyspark.operators.order_stats import unpivot_numeric
from tallyspark.registry import Result, analysis


def group_moments(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def with_levels(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """Long rows (variable, level, value) without missing groups or values."""
    require(df, [group])
    src = df.where(F.col(group).isNotNull()).withColumn("level", F.col(group).cast("string"))
    return unpivot_numeric(src, variables, ["level"]).where(F.col("value").isNotNull())


def levene(long: DataFrame, moments: DataFrame) -> DataFrame:
    """Levene's test on absolute deviations from the group mean; one row per variable."""
    means = moments.select("variable", "level", F.col("mean").alias("centre"))
    dev = long.join(means, ["variable", "level"]).withColumn("value", F.abs(F.col("value") - F.col("centre")))
    z = group_moments(dev, ["variable", "level"])
    return _anova_sums(z).select(
        "variable", F.col("f").alias("levene_f"), F.col("df_between").alias("levene_df1"), F.col("df_within").alias("levene_df2"))


def _anova_sums(moments: DataFrame) -> DataFrame:
    """Sums of squares per variable from (variable, level, n, mean, var) rows; one row per level goes in."""
    per = W.partitionBy("variable")
    grand = F.sum(F.col("n") * F.col("mean")).over(per) / F.sum("n").over(per)
    s = moments.withColumn("grand", grand).groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ss_between"),
        F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("var")).otherwise(0.0)).alias("ss_within"),
    )
    s = s.withColumns({"df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")})
    return s.withColumn("f", F.try_divide(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within")))


def _two_levels(df: DataFrame, group: str) -> list[str]:
    require(df, [group])
    levels = text_levels(df.select(group), group, 3)  # a third level settles the question
    if len(levels) != 2:
        raise ValueError(f"{group!r} must have exactly two groups")
    return levels


@analysis("t_independent", "Independent-samples t-test", "Compare means")
def t_independent(df: DataFrame, variables, group: str) -> Result:
    """Student and Welch tests, Levene's test, and Cohen's d with the pooled SD; first minus second level in text order."""
    a, b = _two_levels(df, group)
    long = with_levels(df, as_list(variables), group)
    moments = group_moments(long, ["variable", "level"])
    desc = moments.select("variable", "level", "n", "mean", F.sqrt("var").alias("sd"), F.sqrt(F.col("var") / F.col("n")).alias("se_mean"))
    pick = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    wide = moments.groupBy("variable").agg(*[pick(lv, c).alias(f"{c}{i}") for i, lv in enumerate((a, b)) for c in ("n", "mean", "var")])
    n0, n1, v0, v1 = F.col("n0"), F.col("n1"), F.col("var0"), F.col("var1")
    pooled = ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)
    e0, e1 = v0 / n0, v1 / n1
    tests = wide.select(
        "variable",
        (F.col("mean0") - F.col("mean1")).alias("difference"),
        ((F.col("mean0") - F.col("mean1")) / F.sqrt(pooled)).alias("cohens_d"),
        F.explode(F.array(
            F.struct(F.lit("Student").alias("test"), F.sqrt(pooled * (1 / n0 + 1 / n1)).alias("se"), (n0 + n1 - 2).cast("double").alias("df")),
            F.struct(F.lit("Welch").alias("test"), F.sqrt(e0 + e1).alias("se"),
                     ((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1))).alias("df")),
        )).alias("r"),
    ).select("variable", "r.test", "difference", "r.se", "r.df", (F.col("difference") / F.col("r.se")).alias("t"), "cohens_d")
    crit = dist.t_quantile(0.975, F.col("df"))
    tests = tests.join(levene(long, moments), "variable", "left").withColumns({
        "p": dist.t_p(F.col("t"), F.col("df")),
        "levene_p": dist.f_p(F.col("levene_f"), F.col("levene_df1"), F.col("levene_df2")),
        "ci_low": F.col("difference") - crit * F.col("se"),
        "ci_high": F.col("difference") + crit * F.col("se"),
    })
    return Result({"groups": desc, "tests": tests})


def _one_mean(moments: DataFrame, mu: float | Column) -> DataFrame:
    se = F.col("sd") / F.sqrt("n")
    out = moments.withColumns({"difference": F.col("mean") - mu, "se": se, "df": F.col("n") - 1}).withColumn("t", F.try_divide("difference", "se"))
    crit = dist.t_quantile(0.975, F.col("df"))
    return out.withColumns({"p": dist.t_p(F.col("t"), F.col("df")), "ci_low": F.col("difference") - crit * se, "ci_high": F.col("difference") + crit * se})


@analysis("t_paired", "Paired-samples t-test", "Compare means")
def t_paired(df: DataFrame, first: str, second: str) -> DataFrame:
    """Paired t-test with Cohen's dz on the complete pairs."""
    diff = numeric(df, [first, second]).select((F.col(first) - F.col(second)).alias("d")).where(F.col("d").isNotNull())
    m = diff.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return _one_mean(m, 0.0).withColumn("dz", F.try_divide("mean", "sd"))


@analysis("t_one_sample", "One-sample t-test", "Compare means")
def t_one_sample(df: DataFrame, variables, mu: float = 0.0) -> DataFrame:
    """One-sample t-test of every variable against a fixed value."""
    long = unpivot_numeric(df, as_list(variables))
    m = long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return _one_mean(m, float(mu)).withColumn("test_value", F.lit(float(mu)))


@analysis("anova_oneway", "One-way ANOVA", "Compare means")
def anova_oneway(df: DataFrame, variable: str, group: str, posthoc: bool = True) -> Result:
    """Sums of squares, effect sizes, Levene and Welch tests, and Tukey comparisons of all pairs."""
    long = with_levels(df, [variable], group)
    moments = group_moments(long, ["variable", "level"])
    sums = _anova_sums(moments)
    msw = F.col("ss_within") / F.col("df_within")
    total = F.col("ss_between") + F.col("ss_within")
    table = sums.select(
        "k", "n", "ss_between", "ss_within", "df_between", "df_within", "f",
        dist.f_p(F.col("f"), F.col("df_between"), F.col("df_within")).alias("p"),
        F.try_divide(F.col("ss_between"), total).alias("eta_squared"),
        F.try_divide(F.col("ss_between") - F.col("df_between") * msw, total + msw).alias("omega_squared"),
    )
    # Welch's test from the k group rows
    per = W.partitionBy("variable")
    w = F.col("n") / F.col("var")
    rows = moments.withColumn("w", w).withColumn("sw", F.sum("w").over(per)).withColumn("centre", F.sum(F.col("w") * F.col("mean")).over(per) / F.col("sw"))
    gap = F.col("mean") - F.col("centre")
    share = 1 - F.col("w") / F.col("sw")
    welch = rows.groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("w") * gap * gap).alias("a"), F.sum(share * share / (F.col("n") - 1)).alias("lam"))
    k = F.col("k").cast("double")
    welch = welch.select(
        F.lit("Welch").alias("test"),
        (F.col("a") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("lam"))).alias("statistic"),
        (k - 1).alias("df1"), ((k * k - 1) / (3 * F.col("lam"))).alias("df2"))
    lev = levene(long, moments).select(
        F.lit("Levene").alias("test"), F.col("levene_f").alias("statistic"), F.col("levene_df1").cast("double").alias("df1"), F.col("levene_df2").cast("double").alias("df2"))
    robust = lev.unionByName(welch).withColumn("p", dist.f_p(F.col("statistic"), F.col("df1"), F.col("df2")))
    out = {
        "groups": moments.select("level", "n", "mean", F.sqrt("var").alias("sd"), F.sqrt(F.col("var") / F.col("n")).alias("se")),
        "anova": table,
        "robust": robust,
    }
    if posthoc:
        out["tukey"] = tukey_pairs(moments, sums)
    return Result(out)


def tukey_pairs(moments: DataFrame, sums: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer comparisons; the input has one row per group level, so the pairs are the result itself."""
    a, b = moments.alias("a"), moments.alias("b")
    pairs = a.join(b, (F.col("a.variable") == F.col("b.variable")) & (F.col("a.level") < F.col("b.level")))
    s = sums.where("k > 2").select("variable", "k", "df_within", (F.col("ss_within") / F.col("df_within")).alias("msw"))
    t = pairs.select(
        F.col("a.variable").alias("variable"), F.col("a.level").alias("group1"), F.col("b.level").alias("group2"),
        (F.col("b.mean") - F.col("a.mean")).alias("difference"), (1 / F.col("a.n") + 1 / F.col("b.n")).alias("inv"),
    ).join(s, "variable")
    t = t.withColumn("se", F.sqrt(F.col("msw") / 2 * F.col("inv"))).withColumn("q", F.abs("difference") / F.col("se"))
    half = dist.range_quantile(1 - alpha, F.col("k"), F.col("df_within")) * F.col("se")
    t = t.withColumns({"p_adjusted": dist.range_p(F.col("q"), F.col("k"), F.col("df_within")), "ci_low": F.col("difference") - half, "ci_high": F.col("difference") + half})
    return t.withColumn("reject", F.col("p_adjusted") < alpha).drop("inv", "msw", "k", "df_within", "variable")


def log_gamma(x: Column) -> Column:
    """Log gamma for x >= 1: Stirling's series after a shift by eight."""
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def fisher_exact(df: DataFrame, row: str, col: str, by: Sequence[str] = (), block: int = 10_000) -> DataFrame:
    """Two-sided exact test of a 2x2 table, one per stratum.

    All tables with the observed margins are laid out in blocks, so a very large stratum
    is spread over many tasks; their probabilities are summed where not above the observed one.
    """
    by = list(by)
    r, c = _two_levels(df, row), _two_levels(df, col)
    isr, isc = F.col(row).cast("string") == r[0], F.col(col).cast("string") == c[0]
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by).agg(
        F.count_if(isr & isc).alias("a"), F.count_if(isr).alias("r1"), F.count_if(isc).alias("c1"), F.count(F.lit(1)).alias("n"))
    low, high = F.greatest(F.lit(0), F.col("r1") + F.col("c1") - F.col("n")), F.least("r1", "c1")
    lf = lambda v: log_gamma(v.cast("double") + 1)
    a, r1, c1, n = (F.col(x) for x in ("a", "r1", "c1", "n"))
    fixed = lf(r1) + lf(n - r1) + lf(c1) + lf(n - c1) - lf(n)
    logp = lambda x: F.col("fixed") - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(n - r1 - c1 + x)
    base = cells.withColumns({"low": low, "high": high, "fixed": fixed}).withColumn("observed", logp(a))
    blocks = base.withColumn("start", F.explode(F.sequence("low", "high", F.lit(block).cast("long")))).repartition(*by, "start")
    x = blocks.withColumn("x", F.explode(F.sequence("start", F.least("high", F.col("start") + block - 1))))
    kept = F.when(logp(F.col("x")) <= F.col("observed") + 1e-7, F.exp(logp(F.col("x")))).otherwise(0.0)
    return x.groupBy(*by, "a", "r1", "c1", "n").agg(F.least(F.lit(1.0), F.sum(kept)).alias("p"))


def wilson_interval(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Wilson score interval for a share; null when n is zero."""
    p = F.try_divide(k, n)
    z2 = z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))
