"""Exact ranks and quantiles without gathering a group in one task.

The distinct values of every group are counted (partial aggregation), spread over
range partitions and written once. The count of smaller values is then the total of
the earlier partitions of the same group plus a running sum inside the partition, so
a group that holds a third of all rows is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyspark.functions.columns import as_list, number, require
from tallyspark.registry import Result, analysis
from tallyspark.runtime import materialize, small_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def unpivot_numeric(df: DataFrame, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (kept columns, variable, value); unreadable values become null."""
    require(df, [*variables, *keep])
    wide = df.select(*keep, *[number(v).alias(f"v{i}") for i, v in enumerate(variables)])
    cases = ", ".join("'{}', v{}".format(v.replace("\\", "\\\\").replace("'", "\\'"), i) for i, v in enumerate(variables))
    return wide.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(variables)}, {cases}) as (variable, value)")


def running_counts(df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None) -> DataFrame:
    """Distinct non-null values per group with their count and the count of smaller values.

    Columns: ``by``, ``value``, ``n``, ``before``, ``total``; every extra weight ``w`` adds
    ``w`` (sum over the equal values), ``w_before`` and ``w_total``.
    """
    by = list(by)
    sums = {"n": F.lit(1), **(weights or {})}
    tallies = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("value"))
        .agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        .repartitionByRange(*by, "value")
        .withColumn("part", F.spark_partition_id())
    )
    tallies = materialize(tallies, "ranges")
    parts = tallies.groupBy(*by, "part").agg(*[F.sum(k).alias(f"{k}_part") for k in sums])
    # at most one row per (group, partition): a short window per group
    earlier = W.partitionBy(*(by or [F.lit(0)])).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(by or [F.lit(0)]))
    offsets = parts.select(
        *by,
        "part",
        *[F.coalesce(F.sum(f"{k}_part").over(earlier), F.lit(0)).alias(f"{k}_offset") for k in sums],
        *[F.sum(f"{k}_part").over(whole).alias(f"{k}_total") for k in sums],
    )
    # null keys are kept apart by a null-safe condition
    left, right = tallies.alias("t"), offsets.alias("o")
    cond = F.col("t.part") == F.col("o.part")
    for k in by:
        cond = cond & F.col(f"t.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = left.join(right, cond).select("t.*", *[f"o.{k}_{s}" for k in sums for s in ("offset", "total")])
    inside = W.partitionBy(*by, "part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    cols = []
    for k in sums:
        before = F.col(f"{k}_offset") + F.coalesce(F.sum(k).over(inside), F.lit(0))
        name, total = ("before", "total") if k == "n" else (f"{k}_before", f"{k}_total")
        cols += [F.col(k), before.alias(name), F.col(f"{k}_total").alias(total)]
    return joined.select(*by, "value", *cols)


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weights: dict[str, Column] | None = None) -> DataFrame:
    """Average rank of every distinct value (ties share the mean of their positions)."""
    return running_counts(df, value, by, weights).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)


#: Hash buckets of the groups, and the rows from which on a bucket's groups are spread over ranges.
BUCKETS, BUCKET_ROWS = 65_536, 1_000_000


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of every group in the given order, also when one group is too large for one task.

    Groups are counted in hash buckets. Those in buckets of ordinary size are numbered after one shuffle; the rows of
    a larger bucket, and with them every large group, are spread over ranges.
    """
    by, order = list(by), list(order)
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    large = [r["b"] for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS).select("b").collect()]  # at most BUCKETS
    plain = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    if not large:
        return df.withColumn(name, plain)
    marks = small_table(df.sparkSession, [(b,) for b in large], "_bucket long")
    marked = df.withColumn("_bucket", bucket)
    rest = marked.join(F.broadcast(marks), "_bucket", "left_anti").drop("_bucket").withColumn(name, plain)
    return rest.unionByName(_range_numbers(marked.join(F.broadcast(marks), "_bucket", "left_semi").drop("_bucket"), by, order, name))


def _range_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """As :func:`row_numbers`, with the rows in ranges: the totals of a group's earlier ranges and a number inside the range."""
    ranged = materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "rows")
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    # null keys are a group of their own
    cond = F.col("t._part") == F.col("o._part")
    for k in by:
        cond = cond & F.col(f"t.`{k}`").eqNullSafe(F.col(f"o.`{k}`"))
    numbered = ranged.alias("t").join(offsets.alias("o"), cond).select("t.*", "o._offset")
    return numbered.withColumn(name, (inside + F.col("_offset")).cast("int")).drop("_part", "_offset")


def quantile_at(p: float) -> Column:
    """Aggregate over ``running_counts`` rows of one group: linear interpolation between order statistics."""
    h = (F.col("total") - 1) * F.lit(float(p))
    covers = lambda i: (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    low = F.max(F.when(covers(F.floor(h)), F.col("value")))
    high = F.max(F.when(covers(F.ceil(h)), F.col("value")))
    frac = F.max(h - F.floor(h))
    return low + (high - low) * frac


def quantiles(df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, one column per requested probability."""
    return running_counts(df, value, by).groupBy(*by).agg(*[quantile_at(p).alias(name) for name, p in probs.items()])


@analysis("qq_table", "Normal quantile table", "Descriptive statistics")
def qq_table(df: DataFrame, variables, points: int = 99) -> Result:
    """Sample quantiles against standard normal quantiles on an even grid of probabilities."""
    from tallyspark.functions.dist import norm_ppf

    vs = as_list(variables)
    probs = [i / (points + 1) for i in range(1, points + 1)]
    rc = running_counts(unpivot_numeric(df, vs), "value", ["variable"])
    packed = rc.groupBy("variable").agg(F.array(*[quantile_at(p) for p in probs]).alias("q"))
    sample = packed.select("variable", F.posexplode("q").alias("i", "sample_quantile"))
    grid = small_table(df.sparkSession, list(zip(range(points), probs, map(float, norm_ppf(probs)))), "i int, p double, normal_quantile double")
    return Result({"qq": sample.join(F.broadcast(grid), "i").select("variable", "p", "normal_quantile", "sample_quantile")})
