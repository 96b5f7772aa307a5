"""Integrity audits: a set of rules compiled to one pass a table, one join a link and one grouping a key."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Audited:
    """A table with its key; ``rules``: code to a SQL condition that a bad row meets; ``links``: code to (column, table, its key); ``unique``: code to columns."""

    rows: DataFrame
    key: str
    rules: dict[str, str] = field(default_factory=dict)
    links: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)


RESULT = ("table", "code", "n_rows", "n_bad", "first_key", "last_key")


def audit(tables: dict[str, Audited]) -> DataFrame:
    """table, code, n_rows (checked), n_bad, and the least and greatest key of a bad row. A condition that is null is met by no row."""
    parts = []
    for name, t in tables.items():
        if t.rules:
            bad = {code: F.coalesce(F.expr(c), F.lit(False)) for code, c in t.rules.items()}
            cells = [F.struct(F.lit(code).alias("code"), F.count("*").alias("n_rows"), F.count_if(c).alias("n_bad"), F.min(F.when(c, F.col(t.key))).cast("string").alias("first_key"), F.max(F.when(c, F.col(t.key))).cast("string").alias("last_key")) for code, c in bad.items()]
            parts.append(t.rows.agg(F.array(*cells).alias("c")).select(F.lit(name).alias("table"), F.inline("c")))
        for code, (column, other, their) in t.links.items():
            # counts by value first, so a value that many rows have crosses once
            held = t.rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"), F.min(t.key).alias("_a"), F.max(t.key).alias("_b"))
            known = tables[other].rows.select(F.col(their).alias("_k")).distinct()
            joined = held.join(known, F.col("_v") == F.col("_k"), "left")
            lost = F.col("_k").isNull()
            parts.append(joined.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(lost, F.col("_n"))), F.lit(0)).alias("n_bad"),
                F.min(F.when(lost, F.col("_a"))).cast("string").alias("first_key"), F.max(F.when(lost, F.col("_b"))).cast("string").alias("last_key"),
            ).select(F.lit(name).alias("table"), F.lit(code).alias("code"), "n_rows", "n_bad", "first_key", "last_key"))
        for code, columns in t.unique.items():
            sizes = t.rows.groupBy(*columns).agg(F.count("*").alias("_n"), F.min(t.key).alias("_a"), F.max(t.key).alias("_b"))
            many = F.col("_n") > 1
            parts.append(sizes.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(many, F.col("_n") - 1)), F.lit(0)).alias("n_bad"),
                F.min(F.when(many, F.col("_a"))).cast("string").alias("first_key"), F.max(F.when(many, F.col("_b"))).cast("string").alias("last_key"),
            ).select(F.lit(name).alias("table"), F.lit(code).alias("code"), "n_rows", "n_bad", "first_key", "last_key"))
    return reduce(DataFrame.unionByName, [p.select(*RESULT) for p in parts])
