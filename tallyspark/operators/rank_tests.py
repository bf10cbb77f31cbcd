"""Mann-Whitney, Wilcoxon and Kruskal-Wallis tests from distributed average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, numeric, text_levels
from tallyspark.operators.hypothesis import _two_levels, with_levels
from tallyspark.operators.order_stats import average_ranks, quantile_at, running_counts
from tallyspark.registry import Result, analysis


def tie_sum() -> Column:
    """Sum of t^3 - t over groups of equal values."""
    t = F.col("n").cast("double")
    return F.sum(t * t * t - t)


def medians(long: DataFrame, keys: list[str]) -> DataFrame:
    return running_counts(long, "value", keys).groupBy(*keys).agg(quantile_at(0.5).alias("median"))


@analysis("mann_whitney", "Mann-Whitney U test", "Non-parametric tests")
def mann_whitney(df: DataFrame, variables, group: str) -> DataFrame:
    """U of the first level, signed z with tie and continuity correction, r = |z|/sqrt(N), medians."""
    a, b = _two_levels(df, group)
    long = with_levels(df, as_list(variables), group)
    ranks = average_ranks(long, "value", ["variable"], {"na": (F.col("level") == a).cast("long")})
    s = ranks.groupBy("variable").agg(
        F.sum("na").alias("n1"), F.max("total").alias("n"), F.sum(F.col("rank") * F.col("na")).alias("r1"), tie_sum().alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    gap = u - n1 * n2 / 2
    z = F.signum(gap) * F.try_divide(F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), sd)
    med = medians(long, ["variable", "level"]).groupBy("variable").agg(
        F.max(F.when(F.col("level") == a, F.col("median"))).alias("median1"), F.max(F.when(F.col("level") == b, F.col("median"))).alias("median2"))
    t = s.select("variable", "n1", (F.col("n") - F.col("n1")).alias("n2"), u.alias("u"), z.alias("z"), (F.abs(z) / F.sqrt(n)).alias("r"))
    return t.join(med, "variable").withColumn("p", dist.norm_p(F.col("z")))


@analysis("wilcoxon", "Wilcoxon signed-rank test", "Non-parametric tests")
def wilcoxon(df: DataFrame, first: str, second: str) -> DataFrame:
    """Zero differences dropped; V is the sum of the positive ranks; normal approximation with continuity correction."""
    d = numeric(df, [first, second]).select((F.col(first) - F.col(second)).alias("d")).where(F.col("d").isNotNull())
    ranks = average_ranks(
        d.select(F.when(F.col("d") != 0, F.abs("d")).alias("size"), (F.col("d") > 0).cast("long").alias("pos")), "size", weights={"pos_n": F.col("pos")})
    pairs = d.agg(F.count(F.lit(1)).alias("n_pairs"))
    s = ranks.agg(F.max("total").alias("n_nonzero"), F.sum(F.col("rank") * F.col("pos_n")).alias("v"), tie_sum().alias("ties"))
    n = F.col("n_nonzero").cast("double")
    mean = n * (n + 1) / 4
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    gap = F.col("v") - mean
    z = F.signum(gap) * F.try_divide(F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), sd)
    return s.join(pairs, F.lit(True)).select("n_pairs", "n_nonzero", "v", z.alias("z")).withColumn("p", dist.norm_p(F.col("z")))


@analysis("kruskal", "Kruskal-Wallis test", "Non-parametric tests")
def kruskal(df: DataFrame, variable: str, group: str) -> Result:
    """Tie-corrected H with epsilon squared, and median and mean rank per group."""
    long = with_levels(df, [variable], group)
    levels = text_levels(long, "level")
    weights = {f"w{i}": (F.col("level") == lv).cast("long") for i, lv in enumerate(levels)}
    ranks = average_ranks(long, "value", ["variable"], weights)
    wide = ranks.agg(
        F.max("total").alias("n"), tie_sum().alias("ties"),
        *[F.sum(F.col("rank") * F.col(w)).alias(f"r_{w}") for w in weights], *[F.sum(w).alias(f"n_{w}") for w in weights])
    rows = wide.select("n", "ties", F.inline(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.col(f"n_w{i}").alias("level_n"), F.col(f"r_w{i}").alias("rank_sum")) for i, lv in enumerate(levels)])))
    n = F.col("n").cast("double")
    test = rows.groupBy("n", "ties").agg(
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("level_n")).alias("s"), F.count(F.lit(1)).alias("k"))
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    test = test.select("n", h.alias("h"), (F.col("k") - 1).alias("df"), (h / (n - 1)).alias("epsilon_squared")).withColumn(
        "p", dist.chi2_p(F.col("h"), F.col("df")))
    groups = rows.select("level", F.col("level_n").alias("n"), (F.col("rank_sum") / F.col("level_n")).alias("mean_rank"))
    return Result({"ranks": groups.join(medians(long, ["level"]), "level"), "test": test})
