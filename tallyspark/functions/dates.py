"""Dates written in several conventions, as days since 1970-01-01."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings.
DAY_FIRST = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\.?(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
YEAR_FIRST = r"^(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
SLASHED = r"\d{1,2}/\d{1,2}/\d{2,4}"
SERIAL = r"^\d+(\.\d+)?$"
SERIAL_RANGE = (20000, 80000)
SERIAL_EPOCH_DAYS = 25569  # days from 1899-12-30 to 1970-01-01
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"
CLOCK_TIME = r"\d{1,2}:\d{2}"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; keeps nested text expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string"))


def _dotted(s: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    part = lambda i: F.regexp_extract(s, pattern, i)
    clock = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(F.lpad(part(i), 2, "0"))
    y, m, d = (part(i) for i in order)
    iso = F.concat(
        y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit(" "),
        clock(4), F.lit(":"), clock(5), F.lit(":"), clock(6), F.lit("Z"),
    )
    return F.when(s.rlike(pattern), iso)


def _micros(s: Column) -> Column:
    """Microseconds of an ISO text; without an offset it is read as UTC."""
    # seconds are filled in, "+0200" becomes "+02:00", and a value without an offset gets one, so the session zone has no say
    s = F.regexp_replace(s, r"([ T]\d{1,2}:\d{2})(\s*(?:Z|[+-]\d{2}:?\d{2}))?$", "$1:00$2")
    s = F.regexp_replace(s, r"(:\d{2}\s*[+-]\d{2})(\d{2})$", "$1:$2")
    with_zone = F.when(s.rlike(CLOCK_TIME) & ~s.rlike(OFFSET), F.concat(s, F.lit("Z"))).when(
        ~s.rlike(CLOCK_TIME), F.concat(s, F.lit(" 00:00:00Z"))
    ).otherwise(s)
    ok = s.rlike(r"^\d{4}-\d{1,2}(-\d{1,2}([ T].*)?)?$")
    return F.when(ok, F.unix_micros(with_zone.try_cast("timestamp")))


def _parse_text(s: Column) -> Column:
    serial = s.try_cast("double")
    ok_serial = s.rlike(SERIAL) & serial.between(*SERIAL_RANGE)
    iso = F.coalesce(_dotted(s, DAY_FIRST, (3, 2, 1)), _dotted(s, YEAR_FIRST, (1, 2, 3)), s)
    return (
        F.when(s == "", F.lit(None).cast("double"))
        .when(ok_serial, serial - SERIAL_EPOCH_DAYS)
        .when(s.rlike(SERIAL) | s.rlike(SLASHED), F.lit(None).cast("double"))
        .otherwise(_let(iso, _micros) / F.lit(86400e6))
    )


def parse_days(col: str | Column) -> Column:
    """Days since 1970-01-01 as a double; null for a blank or an unreadable value."""
    return _let(_text(col), lambda s: F.when(s.isNotNull(), _parse_text(s)))


def days_of(df: DataFrame, name: str) -> Column:
    """Days of a column that holds timestamps, or dates written as text."""
    return timestamp_days(name) if dict(df.dtypes)[name] in ("timestamp", "timestamp_ntz", "date") else parse_days(name)


def problem_of(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast("string") if dict(df.dtypes)[name] in ("timestamp", "timestamp_ntz", "date") else days_problem(name)


def may_have_offset(df: DataFrame, name: str) -> bool:
    """Whether the column is there and could hold times with an offset, which only text can."""
    return name in df.columns and dict(df.dtypes)[name] not in ("timestamp", "timestamp_ntz", "date")


def offset_of(df: DataFrame, name: str) -> Column:
    """As :func:`has_offset`; a timestamp column never carries an offset."""
    if dict(df.dtypes)[name] in ("timestamp", "timestamp_ntz", "date"):
        return F.when(F.col(name).isNotNull(), F.lit(False))
    return has_offset(name)


def days_problem(col: str | Column) -> Column:
    """Why a value could not be read as a date; null when it could, or when it is blank."""
    s = _text(col)
    bad = F.concat(F.lit("'"), s, F.lit("'"))
    return (
        F.when(s.isNull() | (s == "") | parse_days(col).isNotNull(), F.lit(None).cast("string"))
        .when(s.rlike(SLASHED), F.concat(F.lit("ambiguous date "), bad, F.lit(": write it as YYYY-MM-DD")))
        .otherwise(F.concat(F.lit("not a date: "), bad))
    )


def has_offset(col: str | Column) -> Column:
    """True for a clock time with a time-zone offset, null for a blank value."""
    s = _text(col)
    return F.when(s.isNotNull() & (s != ""), s.rlike(CLOCK_TIME) & s.rlike(OFFSET))


def timestamp_days(col: str | Column) -> Column:
    """Days since 1970-01-01 of a timestamp column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp")) / F.lit(86400e6)
