"""Pearson, Spearman and Kendall correlations with pairwise deletion."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, numeric
from tallyspark.operators.order_stats import running_counts
from tallyspark.registry import analysis
from tallyspark.runtime import materialize


def long_pairs(df: DataFrame, variables: list[str]) -> DataFrame:
    """One row per (pair of variables, row of the table) where both values are present."""
    wide = numeric(df, variables).select(*[F.col(v).alias(f"v{i}") for i, v in enumerate(variables)])
    entries = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
        for (i, a), (j, b) in combinations(enumerate(variables), 2)
    ]
    return wide.select(F.inline(F.array(*entries))).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def pearson(df: DataFrame, variables: list[str]) -> DataFrame:
    """All pairs in one aggregation over the wide table."""
    d = numeric(df, variables)
    pairs = list(combinations(variables, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    rows = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return d.agg(*aggs).select(F.inline(F.array(*rows)))


def spearman(df: DataFrame, variables: list[str]) -> DataFrame:
    """All pairs from one table of ranks.

    The rank of a value depends on the other variable of the pair, through the rows that miss it. Every distinct value of a
    variable is therefore counted once with one weight for each partner, and one row of it holds its ranks in all
    pairs; the rows of the table meet these rows once a variable, and no row is repeated for the pairs.
    """
    k = len(variables)
    pairs = list(combinations(range(k), 2))
    present = [F.col(f"v{i}").isNotNull() for i in range(k)]
    wide = numeric(df, variables).select(*[F.col(v).alias(f"v{i}") for i, v in enumerate(variables)])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("x"), *[present[j].cast("long").alias(f"w{j}") for j in range(k)]) for i in range(k)])))
    counts = running_counts(long, "x", ["i"], {f"w{j}": F.col(f"w{j}") for j in range(k)})
    # ranks about their mean: sums of products are then those of the coefficient
    centred = lambda j: F.col(f"w{j}_before") + (F.col(f"w{j}") + 1) / 2.0 - (F.col(f"w{j}_total") + 1) / 2.0
    ranks = materialize(counts.select("i", "value", *[centred(j).alias(f"r{j}") for j in range(k)]), "ranks")
    rows = wide
    for i in range(k):
        mine = ranks.where(F.col("i") == i).select(F.col("value").alias(f"v{i}"), F.struct(*[F.col(f"r{j}") for j in range(k) if j != i]).alias(f"r{i}"))
        rows = rows.join(mine, f"v{i}", "left")
    aggs = []
    for p, (i, j) in enumerate(pairs):
        both = present[i] & present[j]
        x, y = F.when(both, F.col(f"r{i}.r{j}")), F.when(both, F.col(f"r{j}.r{i}"))
        aggs += [F.sum(x * y).alias(f"xy{p}"), F.sum(x * x).alias(f"xx{p}"), F.sum(y * y).alias(f"yy{p}"), F.count_if(both).alias(f"n{p}")]
    out = [F.struct(F.lit(variables[i]).alias("first"), F.lit(variables[j]).alias("second"), F.try_divide(F.col(f"xy{p}"), F.sqrt(F.col(f"xx{p}") * F.col(f"yy{p}"))).alias("r"), F.col(f"n{p}").alias("n"))
           for p, (i, j) in enumerate(pairs)]
    # a pair without a common row has no result
    return rows.agg(*aggs).select(F.inline(F.array(*out))).where("n > 0")


def kendall(df: DataFrame, variables: list[str]) -> DataFrame:
    """Tau-b without forming pairs of rows.

    Every distinct point gets the number of smaller x values as its code. Two points with
    different codes differ first at exactly one binary digit; at that digit they share a
    prefix, one is on the 0 side and the other on the 1 side. Counting, per prefix, the
    0-side points with smaller y below every 1-side point therefore counts every concordant
    pair once. Discordant pairs follow from the totals and the ties.
    """
    keys = ["first", "second"]
    cells = materialize(long_pairs(df, variables).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("c")), "pairs")
    codes = running_counts(cells, "x", keys, {"w": F.col("c")}).select(*keys, F.col("value").alias("x"), F.col("w_before").alias("code"), "w", "w_total")
    points = materialize(cells.join(codes.drop("w"), [*keys, "x"]), "codes")
    digits = int(points.agg(F.max("code")).first()[0] or 0).bit_length()
    level = points.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(max(digits - 1, 0)))))
    prefix = F.expr("shiftright(code, digit + 1)")
    side = F.expr("shiftright(code, digit) & 1")
    counted = running_counts(
        level.withColumns({"prefix": prefix, "side": side}), "y", [*keys, "digit", "prefix"],
        {"zeros": F.when(F.col("side") == 0, F.col("c")).otherwise(0), "ones": F.when(F.col("side") == 1, F.col("c")).otherwise(0)})
    conc = counted.groupBy(*keys).agg(F.sum(F.col("ones").cast("double") * F.col("zeros_before")).alias("concordant"))

    def ties(value):
        t = F.col("t").cast("double")
        by = cells.groupBy(*keys, *value).agg(F.sum("c").alias("t"))
        tag = "".join(value)
        return by.groupBy(*keys).agg(
            F.sum(t * (t - 1) / 2).alias(f"tie_{tag}"), F.sum(t * (t - 1) * (t - 2)).alias(f"t0_{tag}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"t1_{tag}"))

    n = F.col("n").cast("double")
    s = cells.groupBy(*keys).agg(F.sum("c").alias("n")).join(conc, keys, "left").fillna(0.0, ["concordant"])
    for v in (["x"], ["y"], ["x", "y"]):
        s = s.join(ties(v), keys)
    m = n * (n - 1)
    tot = m / 2
    s = s.withColumn("comparable", tot - F.col("tie_x") - F.col("tie_y") + F.col("tie_xy"))
    s = s.withColumn("diff", 2 * F.col("concordant") - F.col("comparable"))
    var = (m * (2 * n + 5) - F.col("t1_x") - F.col("t1_y")) / 18 + 2 * F.col("tie_x") * F.col("tie_y") / m + F.try_divide(
        F.col("t0_x") * F.col("t0_y"), 9 * m * (n - 2))
    return s.select(
        *keys,
        F.try_divide(F.col("diff"), F.sqrt((tot - F.col("tie_x")) * (tot - F.col("tie_y")))).alias("r"), "n",
        F.try_divide(F.col("diff"), F.sqrt(var)).alias("z"))


@analysis("correlation", "Correlations", "Correlate")
def correlation(df: DataFrame, variables, method: str = "pearson") -> DataFrame:
    """Coefficient, p-value and pairwise N per pair; Fisher interval for Pearson's r."""
    vs = as_list(variables)
    if method == "kendall":
        return kendall(df, vs).withColumn("p", dist.norm_p(F.col("z")))
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    out = pearson(df, vs) if method == "pearson" else spearman(df, vs)
    r, n = F.col("r"), F.col("n")
    t = F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))
    out = out.withColumn("p", F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(dist.t_p(t, n - 2)))
    if method == "pearson":
        half = 1.96 / F.sqrt((n - 3).cast("double"))
        z = F.when(n > 3, F.atanh(r))
        out = out.withColumns({"ci_low": F.tanh(z - half), "ci_high": F.tanh(z + half)})
    return out
