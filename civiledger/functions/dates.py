"""Dates and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_ANCHOR, TERM_YEARS = 2025, 4


def term_start(year: Column) -> Column:
    return (TERM_ANCHOR + F.floor((year - TERM_ANCHOR) / TERM_YEARS) * TERM_YEARS).cast("int")


def term_label(start: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("-"), (start + TERM_YEARS - 1).cast("string"))


def week_of_year(d: Column) -> Column:
    """Weeks begin on Monday; days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def parse_date(c: Column) -> Column:
    """ISO or day/month/year; null where it is neither or the year is out of bounds."""
    d = F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd"), F.try_to_date(F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), c), "dd/MM/yyyy"))
    return F.when(F.year(d).between(1900, 2100), d)


def add_months_rolling(d: Column, n: int) -> Column:
    """A day that the month lacks rolls over into the next one."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.dayofmonth(d) - 1)


def inferred_year(c: Column) -> Column:
    """The greatest plausible four-digit year in a text."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int")))


def not_future(d: Column, today: Column) -> Column:
    """The day if it is not after ``today``, else null."""
    return F.when(d <= today, d)


def is_recent(d: Column, today: Column, days: int) -> Column:
    return F.coalesce((d <= today) & (F.date_diff(today, d) < days), F.lit(False))


def diverges(published: Column, year: Column) -> Column:
    """Whether the instrument's year is another than that of its publication; not where either is unknown."""
    return F.coalesce(F.year(published) != year, F.lit(False))


def cadence(year: Column, present: Column) -> Column:
    """How often a year's records are collected again: the older the year, the more seldom."""
    return F.when(year >= present, "daily").when(year == present - 1, "weekly").when(year.isNotNull(), "monthly")
