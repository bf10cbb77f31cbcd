"""Column expressions shared by the operators: coercion, text cleaning, recoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_list(value) -> list[str]:
    """A comma-separated string or a sequence as a trimmed list."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else list(value)
    return [str(p).strip() for p in parts if str(p).strip()]


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def number(col: str | Column) -> Column:
    """Coerce to double; anything unreadable, and NaN, becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the named columns by their numeric view."""
    require(df, columns)
    return df.withColumns({c: number(c) for c in columns})


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listwise deletion over the named columns."""
    return df.dropna(subset=list(columns))


def normalize_text(col: str | Column) -> Column:
    """Collapse runs of white space, trim, and turn null into the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def blank_to_null(col: str | Column) -> Column:
    c = normalize_text(col)
    return F.when(c != "", c)


def lookup(col: Column, mapping: Mapping[str, str]) -> Column:
    """Value of a small literal map, null where the key is absent."""
    if not mapping:
        return F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, col)


def alias_value(col: str | Column, aliases: Mapping[str, str]) -> Column:
    """Lower-cased trimmed text with known synonyms replaced."""
    c = F.lower(normalize_text(col))
    return F.coalesce(lookup(c, aliases), c)


def canonical(col: str | Column, allowed: Sequence[str]) -> Column:
    """Canonical spelling of a case-insensitive match; null if the text is not an allowed value."""
    return lookup(F.lower(normalize_text(col)), {a.lower(): a for a in allowed})


def canonical_loose(col: str | Column, allowed: Sequence[str]) -> Column:
    """As :func:`canonical`, but spaces and dashes are ignored as well."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\s\-–—]+", "")
    keys = {"".join(ch for ch in a.lower() if not ch.isspace() and ch not in "-–—"): a for a in allowed}
    return lookup(squeeze(normalize_text(col)), keys)


def canonicalize(df: DataFrame, column: str, allowed: Sequence[str], where: str) -> tuple[DataFrame, DataFrame]:
    """Replace a coded column by its canonical values; invalid values become blank and a problem row each."""
    text = normalize_text(column)
    good = canonical(column, allowed)
    listed = ", ".join(allowed)
    problems = df.where((text != "") & good.isNull()).select(
        F.lit("ERROR").alias("level"),
        F.col(where).cast("string").alias("where"),
        F.concat(F.lit(f"'{column}' = '"), text, F.lit(f"' is not one of: {listed}")).alias("problem"),
    )
    return df.withColumn(column, F.coalesce(good, F.lit(""))), problems


def split_list(col: str | Column) -> Column:
    """Entries of a ``;`` or ``,`` separated text, trimmed, without blanks."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def reverse_score(col: str | Column, low: float, high: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.lit(float(low + high)) - c


def text_levels(df: DataFrame, column: str, most: int | None = None) -> list[str]:
    """Sorted distinct text levels of a categorical column.

    They become columns of a design or rows of a result on the driver, so the column has to be categorical.
    ``most`` refuses columns with more levels; without it any number is taken.
    """
    rows = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct()
    got = (rows if most is None else rows.limit(most + 1)).collect()
    if most is not None and len(got) > most:
        raise ValueError(f"{column!r} has more than {most} levels")
    return sorted(r.v for r in got)


def strip_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def dummy_columns(column: str, levels: Sequence[str], baseline: str | None = None) -> dict[str, Column]:
    """0/1 columns named ``column=level`` for every level but the baseline (default: the first)."""
    base = levels[0] if baseline is None else baseline
    if base not in levels:
        raise ValueError(f"baseline {base!r} is not a level of {column!r}")
    text = F.col(column).cast("string")
    return {f"{column}={lv}": F.when(text == lv, 1.0).otherwise(0.0) for lv in levels if lv != base}


def first_difference(pairs: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Second minus first wave for every named pair of columns."""
    return {name: number(p[1]) - number(p[0]) for name, p in pairs.items()}


def fuzzy_calibrate(col: str | Column, full_out: float, crossover: float, full_in: float) -> Column:
    """Set membership by a logistic curve through .05, .5 and .95 at the three anchors."""
    if not full_out < crossover < full_in:
        raise ValueError("anchors must increase: full_out < crossover < full_in")
    x = number(col)
    slope = F.lit(2.9444389791664403)  # ln 19
    width = F.when(x <= crossover, F.lit(float(crossover - full_out))).otherwise(F.lit(float(full_in - crossover)))
    m = 1 / (1 + F.exp(-slope * (x - F.lit(float(crossover))) / width))
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), m)))


def interval_low(a: Column, b: Column, factor: Column | float = 1.0) -> Column:
    return F.least(a, b) * factor


def interval_high(a: Column, b: Column, factor: Column | float = 1.0) -> Column:
    return F.greatest(a, b) * factor


# Days per unit of a reported duration.
DAYS_PER_UNIT = {"day": 1.0, "days": 1.0, "week": 7.0, "weeks": 7.0, "month": 30.4375, "months": 30.4375}


def unit_days(col: str | Column) -> Column:
    """Days per unit named in a column; a blank unit means days, an unknown one gives null."""
    c = F.lower(normalize_text(col))
    out = F.when(c == "", 1.0)
    for unit, days in DAYS_PER_UNIT.items():
        out = out.when(c == unit, days)
    return out
