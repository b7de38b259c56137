"""Date and time functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime tokens and their Java patterns (fixed values).
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%%": "%"}
#: Whole days of a unit where a dialect knows no calendar intervals (fixed values).
DAYS_OF_UNIT = {"year": 365, "month": 30, "week": 7, "day": 1}
#: Units of an age by their letters (fixed values).
AGE_UNITS = {"s": "second", "m": "minute", "h": "hour", "d": "day"}


def date_format(value: Column, pattern: str) -> Column:
    """By a strftime pattern; other letters stand for themselves."""
    out = ""
    for token in re.findall(r"%[YmdHMS%]|(?:(?!%[YmdHMS%]).)+", pattern, re.S):
        out += STRFTIME.get(token) or "'" + token.replace("'", "''") + "'"
    return F.date_format(value, out)


def raw_format(value: Column, pattern: str) -> Column:
    """By one of Spark's own patterns."""
    return F.date_format(value, pattern)


def parsed(text: Column, pattern: str) -> Column:
    """A time by a strftime pattern; null if the text doesn't follow it."""
    java = "".join(STRFTIME.get(x) or "'" + x.replace("'", "''") + "'" for x in re.findall(r"%[YmdHMS%]|(?:(?!%[YmdHMS%]).)+", pattern, re.S))
    return F.try_to_timestamp(text, F.lit(java))


def difference(unit: str, earlier: Column, later: Column) -> Column:
    """Whole units from one time to another."""
    return F.timestamp_diff(unit.upper(), earlier, later)


def to_rfc3339(value: Column) -> Column:
    """In whole seconds, in UTC."""
    return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_rfc3339(text: Column) -> Column:
    """With an offset or Z, and fractions of seconds if there are any; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), F.upper(text).try_cast("timestamp"))


def age(since: Column, now: Column, unit: str | None = None) -> Column:
    """The time passed in its largest whole unit: `3d`, `7h`, `5m`, `2s`; a time to come counts as now. With a `unit` of
    these letters, whole units of it, negative for a time to come. Fractions of a second count; null stays null."""
    if unit is not None:
        return F.concat(difference(AGE_UNITS[unit], since, now).cast("string"), F.lit(unit))
    s = difference("second", since, now)
    s = F.when(s < 0, F.lit(0)).otherwise(s)
    out = F.concat(s.cast("string"), F.lit("s"))
    for size, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when(s >= size, F.concat(F.floor(s / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def add_interval(value: Column, n: int, unit: str, calendar: bool = True) -> Column:
    """n units later: by the calendar, or as whole days."""
    unit = unit.lower().rstrip("s")
    if not calendar:
        days = round(n / 24) if unit == "hour" else n * DAYS_OF_UNIT.get(unit, 1)
        return F.date_add(value.cast("date"), days)
    parts = {f"{unit}s" if unit not in ("minute", "second") else {"minute": "mins", "second": "secs"}[unit]: F.lit(n)}
    return value + F.make_interval(**parts)


def day_of_week(value: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(value) - 1


def months_and_days(later: Column, earlier: Column) -> Column:
    """A span as whole months and the days that are left."""
    months = F.floor(F.months_between(later, earlier)).cast("int")
    return F.struct(months.alias("months"), F.datediff(later, F.add_months(earlier, months)).alias("days"))


def ranges_overlap(a: Column, b: Column) -> Column:
    """Whether two half-open ranges struct<lo, hi> share a point."""
    return (a["lo"] < b["hi"]) & (b["lo"] < a["hi"])
