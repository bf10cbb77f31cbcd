"""Coded case evidence: case-code matrix, process-tracing tests, cross-case comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import alias_value, as_list, require
from tallyspark.functions.dates import parse_days
from tallyspark.operators.describe import contingency, distinct_within, mode_per_group
from tallyspark.registry import Result, analysis
from tallyspark.runtime import small_table

# Test names, their aliases, results, and what a result means for the proposition.
TEST_ALIASES = {
    "straw": "straw-in-the-wind",
    "straw-in-wind": "straw-in-the-wind",
    "smokinggun": "smoking-gun",
    "double": "doubly-decisive",
    "doublydecisive": "doubly-decisive",
}
TESTS = ("straw-in-the-wind", "hoop", "smoking-gun", "doubly-decisive")
RESULTS = ("pass", "fail", "unknown", "pending")
IMPLICATIONS = [
    ("straw-in-the-wind", "pass", "weakly supports the proposition; not necessary or sufficient"),
    ("straw-in-the-wind", "fail", "weakly undermines the proposition; not decisive"),
    ("hoop", "pass", "passes a necessary test but does not by itself strongly confirm"),
    ("hoop", "fail", "strongly undermines the proposition because a necessary implication failed"),
    ("smoking-gun", "pass", "strongly supports the proposition; the evidence is highly probative if valid"),
    ("smoking-gun", "fail", "absence/failure is not strongly disconfirming because the test is not necessary"),
    ("doubly-decisive", "pass", "strongly supports the proposition while discriminating against specified rivals"),
    ("doubly-decisive", "fail", "does not satisfy the declared doubly-decisive test; revisit proposition/rivals/evidence"),
]
UNRESOLVED = "unresolved; retain as unknown/pending"


@analysis("case_code_matrix", "Case-code matrix", "Coding")
def case_code_matrix(df: DataFrame, case: str, code: str, source: str, date: str | None = None, form: str | None = None, direction: str | None = None) -> Result:
    """Counts by case and code, provenance per case, direction counts, conflicting codes, chronology."""
    require(df, [case, code, source] + [c for c in (date, form, direction) if c])
    d = df.where(F.col(case).isNotNull() & F.col(code).isNotNull() & F.col(source).isNotNull())
    cells = contingency(d, case, code).select(F.col("row").alias("case"), F.col("col").alias("code"), "n")
    prov = distinct_within(d, [case], {"distinct_sources": source, "distinct_codes": code}).withColumnRenamed("rows", "coded_units")
    if form:
        prov = prov.join(mode_per_group(d.withColumn("_f", F.col(form).cast("string")), [case], "_f").select(case, F.col("mode").alias("form")), case, "left").fillna("", ["form"])
    out = {"matrix": cells, "provenance": prov}
    if direction:
        out["direction"] = d.where(F.col(direction).isNotNull()).groupBy(F.col(case).cast("string").alias("case"), F.col(code).cast("string").alias("code"), F.col(direction).cast("string").alias("direction")).agg(
            F.count(F.lit(1)).alias("n"))
        low = F.lower(F.col(direction).cast("string"))
        flags = d.groupBy(case, code).agg(F.bool_or(low == "support").alias("s"), F.bool_or(low == "oppose").alias("o"))
        clash = flags.where("s and o").select(case, code)
        out["conflicts"] = d.join(clash, [case, code], "left_semi").select(case, code, source).distinct().groupBy(F.col(case).alias("case"), F.col(code).alias("code")).agg(F.count(source).alias("sources"))
    if date:
        days = parse_days(date)
        out["chronology"] = d.groupBy(F.col(case).alias("case")).agg(
            F.min(days).alias("first_day"), F.max(days).alias("last_day"), F.count(days).alias("dated"))
    return Result(out)


@analysis("process_trace", "Process-tracing tests", "Coding")
def process_trace(df: DataFrame, case: str, proposition: str, test_type: str, result: str, source: str, rival: str | None = None) -> Result:
    """Register of tests with their diagnostic meaning, pattern per case and proposition, unresolved count."""
    cols = [case, proposition, test_type, result, source]
    require(df, cols + ([rival] if rival else []))
    raw = F.regexp_replace(F.lower(F.trim(F.col(test_type).cast("string"))), "[_ ]", "-")
    d = df.dropna(subset=cols).withColumns({"test": alias_value(raw, TEST_ALIASES), "outcome": F.lower(F.trim(F.col(result).cast("string")))})
    check = lambda c, allowed, what: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.col(c))))
    d = d.withColumns({"test": check("test", TESTS, "test type"), "outcome": check("outcome", RESULTS, "result")})
    meaning = small_table(df.sparkSession, IMPLICATIONS, "test string, outcome string, implication string")
    reg = d.join(F.broadcast(meaning), ["test", "outcome"], "left").withColumn("implication", F.coalesce("implication", F.lit(UNRESOLVED)))
    pattern = reg.groupBy(F.col(case).cast("string").alias("case"), F.col(proposition).cast("string").alias("proposition"), "test", "outcome").agg(F.count(F.lit(1)).alias("n"))
    open_ = reg.agg(F.count_if(F.col("outcome").isin("unknown", "pending")).alias("unresolved"), F.count(F.lit(1)).alias("tests"))
    return Result({"register": reg.select(case, proposition, "test", "outcome", source, "implication", *([rival] if rival else [])), "pattern": pattern, "unresolved": open_})


@analysis("governance_comparison", "Cross-case comparison", "Coding")
def governance_comparison(df: DataFrame, case: str, form: str, dimensions, order: str) -> Result:
    """First non-null value per case and dimension in the given row order, conflicting values, cross-tabs by form."""
    dims = as_list(dimensions)
    require(df, [case, form, order, *dims])
    d = df.where(F.col(case).isNotNull() & F.col(form).isNotNull())
    text = lambda c: F.col(c).cast("string")
    fields = [form, *dims]
    firsts = [F.coalesce(F.min_by(text(c), F.when(F.col(c).isNotNull(), F.col(order))), F.lit("")).alias(c) for c in fields]
    cases = d.groupBy(F.col(case).alias("case")).agg(*firsts)
    long = d.select(F.col(case).alias("case"), F.col(order).alias("_o"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in fields]))).where("value is not null")
    # one row per distinct value first, so that the list is as long as the number of different codes
    seen = long.groupBy("case", "field", "value").agg(F.min("_o").alias("o"))
    conflicts = seen.groupBy("case", "field").agg(F.array_sort(F.collect_list(F.struct("o", "value"))).alias("v")).where(F.size("v") > 1).select(
        "case", "field", F.array_join(F.transform("v", lambda x: x["value"]), " | ").alias("values"))
    out = {"cases": cases, "conflicts": conflicts}
    for c in dims:
        out[f"by_{c}"] = contingency(cases, form, c).select(F.col("row").alias("form"), F.col("col").alias("value"), "n")
    return Result(out)
