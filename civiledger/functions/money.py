"""Amounts: rounding, parsing, plausibility and tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Halves towards positive infinity."""
    scale = 10**places
    return F.floor(x * scale + F.lit(0.5)) / scale


def parse_money(c: Column) -> Column:
    """``1.234,56`` as a decimal; null where it is none."""
    plain = F.replace(F.replace(F.regexp_replace(c, r"[R$\s]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("decimal(18,2)")


def amounts(c: Column) -> Column:
    """All amounts behind a currency sign in a text."""
    found = F.regexp_extract_all(c, F.lit(r"R\$ ?([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})"), F.lit(1))
    return F.transform(found, parse_money)


def format_money(x: Column) -> Column:
    """``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def plausibility(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), "ok").when(x < 100, "low").when(x > 100_000_000, "high").otherwise("ok")


def compared(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """``ok`` if equal to the cent, ``approx`` within either tolerance, else ``divergent``; null where either is."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), None).when(gap < 0.01, "ok").when((gap <= absolute) | (gap <= F.abs(b) * relative), "approx").otherwise("divergent")


def best_value(total: Column, lot: Column, global_: Column, unit: Column, quantity: Column) -> Column:
    """The first positive value: total, lot, global, unit times quantity, unit."""
    first = lambda c: F.when(c > 0, c)
    return F.coalesce(first(total), first(lot), first(global_), first(unit * quantity), first(unit))
