"""Ordered rules, weighted keywords, prefix categories and extraction from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import amounts
from ..functions.text import fold_lower, references


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose pattern is found."""
    out = None
    for name, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def markers(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of all rules that hit, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))))


def weighted_category(text: Column, groups: dict[str, list[tuple[int, str]]]) -> tuple[Column, Column]:
    """The category with most weight (ties by order) and its confidence; weights count once a group of words."""
    scores = [(name, sum((F.when(text.rlike(p), w).otherwise(0) for w, p in parts), F.lit(0)), sum(w for w, _ in parts)) for name, parts in groups.items()]
    top = F.greatest(*[s for _, s, _ in scores], F.lit(0))
    name = F.coalesce(*[F.when((s == top) & (top > 0), F.lit(n)) for n, s, _ in scores], F.lit("other"))
    confidence = F.coalesce(*[F.when((s == top) & (top > 0), F.round(s / F.lit(most), 4)) for _, s, most in scores], F.lit(0.0))
    return name, confidence


def longest_prefix(rows: DataFrame, code: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """The category of the longest code prefix that matches whole segments. The list is a parameter of a few entries."""
    out = None
    for prefix, name in sorted(prefixes, key=lambda p: (-len(p[0]), p[0])):
        hit = (F.col(code) == prefix) | F.col(code).startswith(prefix + ".")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return rows.withColumn("category", out)


def cited_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row a document and distinct N/YYYY reference, with the number zero-padded."""
    found = docs.select(key, F.explode(F.array_distinct(references(F.col(text)))).alias("reference"))
    number, year = F.split_part("reference", F.lit("/"), F.lit(1)), F.split_part("reference", F.lit("/"), F.lit(2))
    return found.select(key, "reference", F.concat(F.lpad(F.ltrim(number, F.lit("0")), 6, "0"), F.lit("/"), year).alias("padded"))


def single_amount(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The one amount that a document states, null where it states none or several."""
    found = F.array_distinct(amounts(F.col(text)))
    return docs.select(key, F.size(found).alias("n_amounts"), F.when(F.size(found) == 1, found[0]).cast("double").alias("amount"))


def notice_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Modality, process, opening date and object of a notice, and the share of them found."""
    t = fold_lower(F.col(text))
    some = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    fields = {
        "modality": some(r"\b(pregao|concorrencia|tomada de precos|convite|dispensa|inexigibilidade)\b"),
        "process": some(r"processo[^0-9]{0,20}([0-9]{1,6}/[0-9]{2,4})"),
        "opening": some(r"abertura[^0-9]{0,40}([0-9]{2}/[0-9]{2}/[0-9]{4})"),
        "object": some(r"objeto:? *([^.\n]{10,200})"),
    }
    found = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in fields.values()), F.lit(0))
    return docs.select(key, *[c.alias(n) for n, c in fields.items()], (found / F.lit(len(fields))).alias("confidence"))
