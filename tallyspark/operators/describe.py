"""Frequencies, descriptive statistics, missing-data profiles and cross-tabulations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions import dist
from tallyspark.functions.columns import as_list, number, require
from tallyspark.operators.order_stats import QUARTILES, quantile_at, running_counts, unpivot_numeric
from tallyspark.registry import Result, analysis
from tallyspark.runtime import small_table


def unpivot_text(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (kept columns, variable, text value)."""
    require(df, [*variables, *keep])
    wide = df.select(*keep, *[F.col(v).cast("string").alias(f"v{i}") for i, v in enumerate(variables)])
    cases = ", ".join("'{}', v{}".format(v.replace("\\", "\\\\").replace("'", "\\'"), i) for i, v in enumerate(variables))
    return wide.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(variables)}, {cases}) as (variable, level)")


@analysis("frequencies", "Frequencies", "Descriptive statistics")
def frequencies(df: DataFrame, variables) -> DataFrame:
    """Count, percent of all rows and percent of valid rows per level, with a Missing and a Total row."""
    counts = unpivot_text(df, as_list(variables)).groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n"))
    # one grouping-sets pass adds the total row; counts has one row per level already
    both = counts.groupingSets([["variable", "level"], ["variable"]], "variable", "level").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("level").isNotNull(), F.col("n")).otherwise(0)).alias("valid"),
        F.grouping("level").alias("is_total"),
    )
    per_var = W.partitionBy("variable")
    total = F.max(F.when(F.col("is_total") == 1, F.col("n"))).over(per_var)
    n_valid = F.max(F.when(F.col("is_total") == 1, F.col("valid"))).over(per_var)
    label = F.when(F.col("is_total") == 1, "Total").when(F.col("level").isNull(), "Missing").otherwise(F.col("level"))
    valid_pct = (
        F.when(n_valid == 0, F.lit(None).cast("double"))
        .when(F.col("is_total") == 1, 100.0)
        .when(F.col("level").isNotNull(), 100.0 * F.col("n") / n_valid)
    )
    return both.select("variable", label.alias("level"), "n", (100.0 * F.col("n") / total).alias("percent"), valid_pct.alias("valid_percent"))


def bias_corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, F.coalesce(F.nanvl(g1, F.lit(None).cast("double")), F.lit(None)) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


@analysis("descriptives", "Descriptive statistics", "Descriptive statistics")
def descriptives(df: DataFrame, variables, by: str | None = None) -> DataFrame:
    """Moments, exact type-7 quartiles and bias-corrected skewness and kurtosis, optionally split by a column."""
    vs = as_list(variables)
    keys = ["group"] if by else []
    src = df.where(F.col(by).isNotNull()).withColumn("group", F.col(by).cast("string")) if by else df
    long = unpivot_numeric(src, vs, keys)
    g = [*keys, "variable"]
    n = F.count("value")
    x = F.col("value")
    moments = long.groupBy(*g).agg(
        n.alias("n"),
        F.count_if(x.isNull()).alias("missing"),
        F.avg(x).alias("mean"),
        F.when(n > 1, F.stddev_samp(x)).alias("sd"),
        F.when(n > 1, F.stddev_samp(x) / F.sqrt(n)).alias("se_mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        bias_corrected_skew(n, F.skewness(x)).alias("skewness"),
        bias_corrected_kurtosis(n, F.kurtosis(x)).alias("kurtosis"),
    )
    cuts = running_counts(long, "value", g).groupBy(*g).agg(*[quantile_at(p).alias(k) for k, p in QUARTILES.items()])
    return moments.join(cuts, g, "left").select(
        *g, "n", "missing", "mean", "sd", "se_mean", "min", "q1", "median", "q3", "max", "skewness", "kurtosis"
    )


@analysis("summary", "Summary tables", "Descriptive statistics")
def summary(df: DataFrame, variables, by: str | None = None) -> Result:
    """Numeric description, level percentages of the text columns, and means by group."""
    cols = as_list(variables)
    require(df, cols)
    kinds = dict(df.dtypes)
    is_num = lambda c: kinds[c].split("(")[0] in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal"}
    num = [c for c in cols if is_num(c)]
    cat = [c for c in cols if not is_num(c)]
    out: dict[str, DataFrame] = {}
    if num:
        out["numeric"] = descriptives(df, num).select("variable", "n", "missing", "mean", "sd", "min", "q1", "median", "q3", "max")
    if cat:
        f = frequencies(df, cat)
        out["categorical"] = f.where("level <> 'Total'").select("variable", "level", "n", "percent")
    if by:
        src = unpivot_numeric(df.where(F.col(by).isNotNull()), [c for c in num if c != by], [by])
        out["means_by"] = src.groupBy(by, "variable").agg(
            F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
        )
    return Result(out)


@analysis("columns_profile", "Columns", "Descriptive statistics")
def columns_profile(df: DataFrame, columns=None, approximate: bool = False) -> DataFrame:
    """Name, type, non-missing count and distinct count of every column, in one pass."""
    cols = as_list(columns) or df.columns
    require(df, cols)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    kinds = dict(df.dtypes)
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (F.count(c).alias(f"n{i}"), distinct(F.col(c)).alias(f"d{i}"))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("non_missing"), F.col(f"d{i}").alias("distinct"))
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(rows))


def _is_missing(df: DataFrame, column: str) -> Column:
    blank = F.col(column).isNull()
    kind = dict(df.dtypes)[column]
    if kind == "string":
        return blank | (F.trim(F.regexp_replace(column, r"(?U)\s", "")) == "")
    return blank | F.isnan(column) if kind in ("double", "float") else blank


@analysis("missing", "Missing data", "Data quality")
def missing(df: DataFrame, variables, top: int = 15) -> Result:
    """Missing count per variable, and the most frequent missingness patterns."""
    vs = as_list(variables)
    require(df, vs)
    flags = [_is_missing(df, v).alias(f"m{i}") for i, v in enumerate(vs)]
    # whole pattern table is at most one row per observed pattern; both results come from it
    patterns = df.select(*flags).groupBy(*[f"m{i}" for i in range(len(vs))]).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    wide = patterns.agg(total.alias("total"), *[F.coalesce(F.sum(F.when(F.col(f"m{i}"), F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(len(vs))])
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"c{i}").alias("missing"), (100.0 * F.col(f"c{i}") / F.col("total")).alias("percent"))
                     for i, v in enumerate(vs)])
    names = F.array_compact(F.array(*[F.when(F.col(f"m{i}"), F.lit(v)) for i, v in enumerate(vs)]))
    pattern = F.when(F.size(names) == 0, "(complete)").otherwise(F.array_join(names, " + "))
    listed = patterns.select(pattern.alias("pattern"), "n").orderBy(F.desc("n"), "pattern").limit(top)
    return Result({"variables": wide.select(F.inline(rows)), "patterns": listed})


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long table of cell counts; null pairs dropped, both variables as text."""
    require(df, [row, col])
    return (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def full_grid(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every row level with every column level of a contingency table, zero-filled, with margins and expected counts.

    Works on cell counts only: its size is the product of the two level counts.
    """
    by = list(by)
    rows = cells.groupBy(*by, "row").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*by, "col").agg(F.sum("n").alias("col_n"))
    grid = rows.join(cols, by) if by else rows.join(cols, F.lit(True))
    total = F.sum("n").over(W.partitionBy(*(by or [F.lit(0)])))
    return (
        grid.join(cells, [*by, "row", "col"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("total", total)
        .withColumn("expected", F.col("row_n") * F.col("col_n") / F.col("total"))
    )


def association_aggregates(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square, likelihood ratio, Yates correction and Cramér's V from a full grid, per stratum if asked."""
    n, e = F.col("n"), F.col("expected")
    yates_gap = F.greatest(F.abs(n - e) - F.least(F.lit(0.5), F.abs(n - e)), F.lit(0.0))
    agg = grid.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.count_distinct("row").alias("rows"),
        F.count_distinct("col").alias("cols"),
        F.sum((n - e) * (n - e) / e).alias("chi_square"),
        (2 * F.sum(F.when(n > 0, n * F.log(n / e)).otherwise(0.0))).alias("likelihood_ratio"),
        F.sum(yates_gap * yates_gap / e).alias("yates"),
        F.avg(F.when(e < 5, 1.0).otherwise(0.0)).alias("low_expected_share"),
    )
    k = F.least("rows", "cols")
    two = (F.col("rows") == 2) & (F.col("cols") == 2)
    return agg.withColumns({
        "df": (F.col("rows") - 1) * (F.col("cols") - 1),
        "yates": F.when(two, F.col("yates")),
        "cramers_v": F.when(k > 1, F.sqrt(F.col("chi_square") / (F.col("n") * (k - 1)))),
        "low_expected_warning": F.col("low_expected_share") > 0.2,
    })


@analysis("crosstabs", "Cross-tabulation", "Descriptive statistics")
def crosstabs(df: DataFrame, row: str, col: str) -> Result:
    """Cell counts with totals, row percentages, and tests of association."""
    cells = contingency(df, row, col)
    counts = cells.cube("row", "col").agg(F.sum("n").alias("n"), F.grouping("row").alias("gr"), F.grouping("col").alias("gc"))
    counts = counts.select(
        F.when(F.col("gr") == 1, "Total").otherwise(F.col("row")).alias("row"),
        F.when(F.col("gc") == 1, "Total").otherwise(F.col("col")).alias("col"),
        "n",
    )
    grid = full_grid(cells)
    tests = association_aggregates(grid).withColumns({
        "p": dist.chi2_p(F.col("chi_square"), F.col("df")),
        "p_likelihood_ratio": dist.chi2_p(F.col("likelihood_ratio"), F.col("df")),
        "p_yates": dist.chi2_p(F.col("yates"), F.lit(1.0)),
    })
    return Result({
        "counts": counts,
        "row_percent": grid.select("row", "col", (100.0 * F.col("n") / F.col("row_n")).alias("row_percent")),
        "tests": tests,
    })


def pairwise_counts(df: DataFrame, variables) -> DataFrame:
    """Number of rows on which both variables of a pair are present, for every pair."""
    vs = as_list(variables)
    require(df, vs)
    pairs = [(a, b) for a in vs for b in vs]
    wide = df.agg(*[F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("n")) for i, (a, b) in enumerate(pairs)
    ])))


def value_counts(df: DataFrame, column: str, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts over a fixed list of categories, zero-filled."""
    counts = df.groupBy(*keys, F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    frame = small_table(df.sparkSession, list(enumerate(categories)), "position int, category string")
    grid = counts.select(*keys).distinct().join(F.broadcast(frame), F.lit(True)) if keys else frame
    return grid.join(counts, [*keys, "category"], "left").select(*keys, "position", "category", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_share(table: DataFrame, value: str, order: Sequence[Column | str]) -> DataFrame:
    """Share and running share of a short result table."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(value).over(W.partitionBy(F.lit(0)))
    return table.withColumn("share", F.col(value) / total).withColumn("cumulative_share", F.sum(value).over(w) / total)


def distinct_within(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Distinct non-null values of several columns inside each group, one output column each."""
    parts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))]
    parts += [df.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(name)) for name, c in columns.items()]
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null value per group; the smallest value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # largest count, then smallest value, as a mergeable aggregate: no sort of a whole group
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(top, [*keys, "n"]).groupBy(*keys).agg(F.min(value).alias("mode"), F.first("n").alias("n"))


def first_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str | Column) -> DataFrame:
    """First non-null value of every column per group in the given order."""
    o = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in columns])
