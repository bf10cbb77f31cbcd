"""Integrity and consistency checks: one row per rule with the number of offending units, and the units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import blank_to_null
from tallyspark.operators.screening import all_criteria, allowed_values, columns_of, source_kind
from tallyspark.registry import Result
from tallyspark.runtime import small_table

class Check(NamedTuple):
    """A rule: its level when broken, its wording, the table, and the units that break it (column unit)."""

    level: str
    check: str
    where: str
    units: DataFrame


def _row(bad: DataFrame, level: str, check: str, where: str, unit: str = "episode") -> Check:
    return Check(level, check, where, bad.select(F.col(f"`{unit}`").cast("string").alias("unit")))


def offenders(checks: Sequence[Check]) -> DataFrame:
    """``level, check, where, unit``: every unit that breaks a rule, once for each rule."""
    return reduce(DataFrame.unionByName, [c.units.select(F.lit(c.level).alias("level"), F.lit(c.check).alias("check"), F.lit(c.where).alias("where"), "unit") for c in checks]).distinct()


def integrity(checks: Sequence[Check]) -> DataFrame:
    """One row for each rule: PASS with zero, otherwise its level with the number of different units that break it."""
    spark = checks[0].units.sparkSession
    rules = small_table(spark, [(c.level, c.check, c.where) for c in checks], "level string, check string, where string")
    n = offenders(checks).groupBy("level", "check", "where").agg(F.count(F.lit(1)).alias("n"))
    d = rules.join(n, ["level", "check", "where"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return d.select(F.when(F.col("n") > 0, F.col("level")).otherwise("PASS").alias("level"), "check", "where", "n")


def _clean(df: DataFrame, c: str) -> DataFrame:
    return df.select(blank_to_null(F.col(f"`{c}`")).alias("v")).where("v is not null")


def check_unique(df: DataFrame, key: str, where: str, level: str = "FAIL") -> Check:
    return _row(_clean(df, key).groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), level, f"{key} unique", where, "v")


def check_required(df: DataFrame, trigger: Column, needed: Sequence[str], check: str, where: str, unit: str, level: str = "FAIL") -> Check:
    """Units on which the trigger holds but a needed field is blank."""
    blank = reduce(lambda a, b: a | b, [blank_to_null(F.col(f"`{c}`")).isNull() for c in needed])
    return _row(df.where(trigger & blank), level, check, where, unit)


def check_condition(df: DataFrame, bad: Column, check: str, where: str, unit: str, level: str = "FAIL") -> Check:
    return _row(df.where(bad), level, check, where, unit)


def check_reference(child: DataFrame, column: str, parent: DataFrame, key: str, check: str, where: str, level: str = "FAIL") -> Check:
    """Distinct child values without a parent row."""
    c, p = _clean(child, column).distinct(), _clean(parent, key).distinct()
    return _row(c.join(p, "v", "left_anti"), level, check, where, "v")


def check_allowed(df: DataFrame, column: str, allowed: Sequence[str], where: str, unit: str, level: str = "FAIL") -> Check:
    """Units whose value is not in the list; blank values are left to ``check_required``."""
    v = blank_to_null(F.col(f"`{column}`"))
    return _row(df.where(v.isNotNull() & ~v.isin(*allowed)), level, f"{column} outside the list", where, unit)


# Bands of a commitment in local currency (lower bound, upper bound, label).
MONEY_BANDS = [(0, 200_000, "< 200k"), (200_000, 1_000_000, "200k–1M"), (1_000_000, 5_000_000, "1M–5M"), (5_000_000, None, "≥ 5M")]


def money_bands(df: DataFrame, amount: str, currency: str, rate: str, local: str = "HUF") -> DataFrame:
    """Documents per band of the local-currency amount; bands without documents count zero."""
    a, r = F.col(amount).try_cast("double"), F.col(rate).try_cast("double")
    v = F.when(F.trim(F.coalesce(F.col(currency), F.lit(""))) == local, a).otherwise(a * r)
    band = F.lit(None).cast("string")
    for low, high, label in reversed(MONEY_BANDS):
        inside = (v >= low) & (v < high) if high else v >= low
        band = F.when(inside, label).otherwise(band)
    counts = df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("documents")).where("band is not null")
    frame = small_table(df.sparkSession, [(i, b[2]) for i, b in enumerate(MONEY_BANDS)], "position int, band string")
    return frame.join(counts, "band", "left").select("position", "band", F.coalesce("documents", F.lit(0)).alias("documents"))


# Step names that hint at a clock, the neutral form of an episode code, levels not analysed.
PAYMENT_WORDS = ("pay", "deposit", "instal", "transfer", "remit")
READINESS_WORDS = ("operational", "install", "commission", "training", "opening", "go-live")
NEUTRAL_CODE = r"^(E\d{1,3}[a-z]?|[A-Z]{2}-M\d{1,3}[A-Z]?|EX-?\d+|ZZ\d+)$"
NOT_ANALYSABLE = ("Outside analytic archive", "Held at S0")


def _analysable(level: Column) -> Column:
    return (level != "") & ~reduce(lambda a, b: a | b, [level.startswith(x) for x in NOT_ANALYSABLE])


def consistency_checks(episodes: DataFrame, verdicts: DataFrame, timeline: DataFrame | None, steps: DataFrame, candidates: DataFrame | None = None, key: str = "episode",
                       expected_criterion: str | None = None, independent_criterion: str | None = None, source_column: str | None = None) -> Result:
    """Cross-checks between screened episodes, recorded results, computed verdicts, timelines and the candidate list.

    ``episodes``: key, level, recorded_verdict, rival and the criterion columns. ``timeline``: episode.
    ``steps``: episode, step, clock, expected_days, zero_documented. ``candidates``: candidate, decision. Without a
    ``timeline`` the episodes of the steps are those with one.

    Every table says something about episodes. What it says is a set of bits, and the bits of an episode meet in one
    row, on which all rules are read; no table is gone through for each rule.
    """
    txt = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    has_word = lambda c, words: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words])
    bit: dict[str, int] = {}

    def mask(**said: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << bit.setdefault(k, len(bit))).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in said.items()])

    none = F.lit(None).cast("string")
    level, recorded, rival = txt("level"), txt("recorded_verdict"), txt("rival")
    top = level == "Level 3"
    said = {"listed": F.lit(True), "top": top, "unrecorded": top & (recorded == ""), "no_rival": top & ~rival.isin("Rejected", "Not rejected"), "odd_code": ~F.trim(F.col(key).cast("string")).rlike(NEUTRAL_CODE)}
    if expected_criterion:
        said |= {"expected_top": (txt(expected_criterion) == "Yes") & top, "expected": (txt(expected_criterion) == "Yes") & ~top}
    if independent_criterion and source_column:
        said["uncoded"] = (level.startswith("Level 2") | level.startswith("Level 3")) & (txt(independent_criterion) != "Yes") & source_kind(txt(source_column)).isin("", "pending")
    noted = F.when(recorded != "", recorded)
    parts = [episodes.select(F.trim(F.col(key).cast("string")).alias("episode"), mask(**said).alias("bits"), noted.alias("recorded"), none.alias("verdict")),
             verdicts.select(F.col("episode").cast("string").alias("episode"), mask(fragile=F.col("fragile") == "Yes", not_computable=F.lower("finance_actionable").contains("not computable")).alias("bits"),
                             none.alias("recorded"), F.col("verdict").cast("string").alias("verdict"))]
    days = F.col("expected_days").try_cast("double")
    clock = F.lower(txt("clock"))
    of_step = {"open": days.isNull(), "zero": days == 0, "undocumented": (days == 0) & ~F.lower(txt("zero_documented")).isin("yes", "y", "true", "1", "igen", "evet", "بله"),
               "payment": has_word(txt("step"), PAYMENT_WORDS) & (clock == "finance"), "readiness": has_word(txt("step"), READINESS_WORDS) & ~clock.isin("operational-readiness", "operational readiness")}
    if timeline is None:
        of_step["timed"] = F.lit(True)
    name = F.trim(F.col("episode").cast("string")).alias("episode")
    steps_said = steps.select(name, mask(**of_step).alias("bits"))
    if timeline is not None:
        steps_said = steps_said.unionByName(timeline.select(name, mask(timed=F.lit(True)).alias("bits")))
    parts.append(steps_said.where("episode <> ''").groupBy("episode").agg(F.bit_or("bits").alias("bits")).select("episode", "bits", none.alias("recorded"), none.alias("verdict")))
    if candidates is not None:
        parts.append(candidates.select(txt("candidate").alias("episode"), mask(kept=txt("decision") == "Retained", undecided=txt("decision") == "").alias("bits"), none.alias("recorded"), none.alias("verdict")).where("episode <> ''"))
    facts = reduce(DataFrame.unionByName, parts).groupBy("episode").agg(
        F.bit_or("bits").alias("bits"), *[f(c).alias(f"{c}_{n}") for c in ("recorded", "verdict") for n, f in (("min", F.min), ("max", F.max))])
    on = lambda k: F.col("bits").bitwiseAND(F.lit(1 << bit[k]).cast("long")) != 0
    # some recorded verdict differs from some computed one, unless all of them are the same
    differs = F.col("episode").isNotNull() & ((F.col("recorded_min") != F.col("verdict_max")) | (F.col("recorded_max") != F.col("verdict_min")))
    rules = [("FAIL", "Level-3 episode without a timeline", "timeline", on("top") & ~on("timed")), ("WARN", "Timeline of an episode that is not Level 3", "timeline", on("timed") & ~on("top"))]
    if expected_criterion:
        rules.append(("FAIL", "Expected durations coded as documented but blank in the steps", "steps", (on("expected_top") | (on("expected") & on("timed"))) & on("open")))
    rules += [
        ("WARN", "Expected duration of exactly 0 days", "steps", on("zero")), ("FAIL", "Recorded verdict differs from the computed one", "episodes", differs),
        ("WARN", "Level-3 episode with no verdict recorded", "episodes", on("unrecorded")), ("WARN", "Fragile verdict: decisive slack within one day of zero", "verdicts", on("fragile")),
        ("WARN", "Duration 0 without zero_documented = Yes (treated as missing)", "steps", on("undocumented")), ("WARN", "Finance actionability not computable", "verdicts", on("not_computable")),
        ("FAIL", "Level-3 episode without a valid rival result", "episodes", on("no_rival")), ("WARN", "Payment-type step coded on the finance clock", "steps", on("payment")),
        ("WARN", "Readiness-type step not on the readiness clock", "steps", on("readiness"))]
    if candidates is not None:
        rules += [("FAIL", "Episode that is not retained in the candidate list", "candidates", on("listed") & ~on("kept")), ("WARN", "Retained candidate missing from the episodes", "candidates", on("kept") & ~on("listed")),
                  ("WARN", "Candidate without a decision", "candidates", on("undecided"))]
    if "uncoded" in bit:
        rules.append(("WARN", "Independence not met but source kind not coded", "episodes", on("uncoded")))
    rules.append(("WARN", "Episode code does not look like a neutral pseudonym", "episodes", on("odd_code")))
    fixed = lambda *r: [F.lit(v).alias(n) for v, n in zip(r, ("level", "check", "where"))]
    broken = facts.select(F.col("episode").alias("unit"), F.inline(F.array(*[F.struct(*fixed(*r), F.coalesce(bad, F.lit(False)).alias("bad")) for *r, bad in rules])))
    counts = facts.agg(*[F.count_if(bad).alias(f"n{i}") for i, (*_, bad) in enumerate(rules)])
    table = counts.select(F.inline(F.array(*[F.struct(F.when(F.col(f"n{i}") > 0, r[0]).otherwise("PASS").alias("level"), *fixed(*r)[1:], F.col(f"n{i}").alias("n")) for i, (*r, _) in enumerate(rules)])))
    return Result({"checks": table, "offenders": broken.where("bad").select("level", "check", "where", "unit")})


def descriptive_fields(episodes: DataFrame, fields: Sequence[Mapping]) -> Result:
    """Value counts and problems of descriptive (non-gate) fields.

    A field has ``column``, ``allowed`` and optionally ``required_when``: a condition as SQL text over
    the episode's columns. A blank field that is not required, and 'N/A', are not counted.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\-–—_/()]+", " "))
    entries = []
    for f in fields:
        raw = F.trim(F.coalesce(F.col(f"`{f['column']}`").cast("string"), F.lit("")))
        value = F.when(raw == "", "")
        for a in f["allowed"]:
            value = value.when(squeeze(raw) == squeeze(F.lit(a)), a)
        need = F.coalesce(F.expr(f["required_when"]), F.lit(False)) if f.get("required_when") else F.lit(False)
        entries.append(F.struct(F.lit(f["column"]).alias("field"), value.alias("value"), need.alias("required")))
    long = episodes.select(F.inline(F.array(*entries))).groupBy("field", "value", "required").agg(F.count(F.lit(1)).alias("n"))
    shown = F.col("required") | (F.coalesce("value", F.lit("invalid value")).isin("", "N/A") == F.lit(False))
    counts = long.where(shown).groupBy("field", F.when(F.col("value") == "", "blank").otherwise(F.coalesce("value", F.lit("invalid value"))).alias("value")).agg(F.sum("n").alias("episodes"))
    bad = long.groupBy("field").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("invalid"), F.sum(F.when(F.col("required") & F.col("value").isin("", "PENDING"), F.col("n")).otherwise(0)).alias("missing"))
    checks = bad.select("field", F.inline(F.array(
        F.struct(F.lit("value not in the allowed list").alias("check"), F.col("invalid").alias("n"), F.when(F.col("invalid") > 0, "FAIL").otherwise("PASS").alias("level")),
        F.struct(F.lit("required but blank or PENDING").alias("check"), F.col("missing").alias("n"), F.when(F.col("missing") > 0, "WARN").otherwise("PASS").alias("level")))))
    return Result({"counts": counts, "checks": checks})


def temporal_ladder(episodes: DataFrame, steps: Mapping[str, str]) -> DataFrame:
    """Yes, No and open counts of the given columns (column to label) among analysable episodes."""
    an = episodes.where(_analysable(F.coalesce(F.col("level"), F.lit(""))))
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    long = an.select(F.inline(F.array(*[F.struct(F.lit(lab).alias("step"), text(c).alias("v")) for c, lab in steps.items()])))
    return long.groupBy("step").agg(F.count_if(F.col("v").isin("Yes", "COMPLETE")).alias("yes"), F.count_if(F.col("v") == "No").alias("no"),
                                    F.count_if(~F.col("v").isin("Yes", "COMPLETE", "No")).alias("open"), F.count(F.lit(1)).alias("of_analysable"))


def finance_ladder(episodes: DataFrame, observed: str, verdicts: DataFrame) -> DataFrame:
    """Financing observed, usable in time, and binding."""
    an = episodes.where(_analysable(F.coalesce(F.col("level"), F.lit("")))).agg(F.count_if(F.trim(F.col(f"`{observed}`")) == "Yes").alias("n0"))
    fb = F.col("verdict") == "Finance-binding"
    v = verdicts.agg(F.count_if(F.col("finance_actionable") == "Yes").alias("n1"), F.count_if(F.lower("finance_actionable").contains("not computable")).alias("n2"),
                     F.count_if(fb).alias("n3"), F.count_if(fb & (F.col("fragile") == "Yes")).alias("n4"))
    names = ("financing observed", "temporally actionable", "actionability not computable", "finance-binding", "of which fragile")
    return an.join(v, F.lit(True)).select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(x).alias("claim"), F.col(f"n{i}").alias("episodes")) for i, x in enumerate(names)])))


def pipeline_counts(register: DataFrame, search_log: DataFrame, candidates: DataFrame, episodes: DataFrame, source: str = "source", flags: Sequence[str] = ("unique", "in_window", "cleared")) -> DataFrame:
    """Counts from registered records to levels."""
    txt = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    reg = register.withColumn("_s", txt(source)).where("_s <> ''")
    analytic = reduce(lambda a, b: a & b, [txt(f) == "Yes" for f in flags])
    one = lambda d, stage, pos: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(pos).alias("position"), F.lit(stage).alias("stage"), "n")
    searched = search_log.select(txt(source).alias("_s")).where("_s <> ''").distinct()
    cand = candidates.withColumn("d", txt("decision")).where(txt("candidate") != "")
    rows = [
        one(reg, "records registered", 0), one(reg.where(txt(flags[0]) == "Yes"), "unique records", 1), one(reg.where(analytic), "analytic sources", 2),
        one(reg.where(analytic).join(searched, "_s", "left_semi"), "analytic sources searched", 3), one(cand, "candidates", 4),
        *[one(cand.where(F.col("d") == x), x.lower(), 5 + i) for i, x in enumerate(("Retained", "Merged", "Not admitted"))], one(episodes, "episodes screened", 8)]
    levels = episodes.groupBy(F.coalesce(F.nullif(F.trim("level"), F.lit("")), F.lit("not assigned")).alias("stage")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(9).alias("position"), "stage", "n")
    return reduce(DataFrame.unionByName, [*rows, levels])


def status_summary(episodes: DataFrame, sources: DataFrame, checks: DataFrame, frozen: bool) -> DataFrame:
    """Source states, level counts and check counts of a project in one row, with the current step."""
    s = F.upper(F.trim(F.coalesce(F.col("status"), F.lit(""))))
    src = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(s == "COMPLETE").alias("complete"), F.count_if(s == "HELD").alias("held"), F.count_if(~s.isin("COMPLETE", "HELD")).alias("pending"))
    lv = episodes.agg(F.count(F.lit(1)).alias("episodes"), *[F.count_if(F.col("level").startswith(f"Level {i}")).alias(f"level_{i}") for i in (1, 2, 3)], F.count_if(F.col("level").startswith("Held")).alias("episodes_held"))
    ck = checks.agg(F.count_if(F.col("level") == "FAIL").alias("fail"), F.count_if(F.col("level") == "WARN").alias("warn"))
    step = F.when((F.col("sources") == 0) | (F.col("pending") > 0), "A" if not frozen else "D").otherwise("D" if frozen else "B")
    step = F.when((F.col("sources") > 0) & (F.col("pending") > 0), "A").otherwise(step)
    return src.join(lv, F.lit(True)).join(ck, F.lit(True)).withColumn("step", step)


def lock_readiness(rules: Mapping, episodes: DataFrame, problems: DataFrame, checks: DataFrame, justified: Sequence[str] = ()) -> DataFrame:
    """Reasons not to lock: unfrozen rules, errors, failed checks, pending gate values, warnings without a justification.

    ``justified`` are the texts of accepted warnings; a warning is covered when it contains one of them.
    """
    ep = rules["episode_column"]
    row = lambda d, area, text: d.select(F.lit(area).alias("area"), text.alias("blocker"))
    out = []
    if not rules.get("frozen"):
        out.append(small_table(episodes.sparkSession, [("Rules", f"{rules['protocol_version']} is not frozen")], "area string, blocker string"))
    text = F.concat_ws(" — ", "where", "problem")
    out.append(row(problems.where("level = 'ERROR'"), "Screening", text))
    out.append(row(checks.where("level = 'FAIL'"), "Consistency", F.concat_ws(" — ", "check", "where")))
    gates = [c for crit in all_criteria(rules) if crit.get("gate", True) is not False for c in columns_of(crit) if c in episodes.columns]
    pending = reduce(lambda a, b: a | b, [F.trim(F.col(f"`{c}`")) == "PENDING" for c in gates], F.lit(False))
    out.append(row(episodes.where(_analysable(F.col("level")) & pending), "PENDING", F.concat(F.lit("gate criteria still PENDING: "), F.col(ep).cast("string"))))
    warn = row(problems.where("level = 'WARN'"), "Undocumented warning", text).unionByName(row(checks.where("level = 'WARN'"), "Undocumented warning", F.concat_ws(" — ", "check", "where")))
    for note in {j.strip() for j in justified if j.strip()}:
        warn = warn.where(~F.col("blocker").contains(note))
    out.append(warn)
    return reduce(DataFrame.unionByName, out)


def data_dictionary(tables: Mapping[str, DataFrame], rules: Mapping | None = None) -> DataFrame:
    """Field, type, non-missing and distinct counts, allowed values and meaning of every column of every table."""
    from tallyspark.operators.describe import columns_profile

    allowed = {c: "" if v is None else " | ".join(v) for c, v in (allowed_values(rules) if rules else {}).items()}
    meaning = {c: f"{'Gate' if crit.get('gate', True) else 'Flag'} {crit['id']}: {crit.get('label', '')}".rstrip(": ") for crit in (all_criteria(rules) if rules else []) for c in columns_of(crit)}
    parts = [columns_profile(t).withColumn("table", F.lit(name)) for name, t in tables.items()]
    d = reduce(DataFrame.unionByName, parts)
    look = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("column")), F.lit("")) if m else F.lit("")
    return d.select("table", F.col("column").alias("field"), "type", "non_missing", "distinct", look(allowed).alias("allowed"), look(meaning).alias("meaning"))
