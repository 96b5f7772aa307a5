"""Fiscal aggregates over ledger entries (see ``sources.tables.ledger``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import term_label, term_start
from ..functions.money import half_up


def is_payment_order(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("")).ilike("P%")


def is_estimate(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("")).ilike("O%")


def is_ordinary(kind: Column) -> Column:
    """Everything else, an unknown kind included."""
    return ~is_payment_order(kind) & ~is_estimate(kind)


def conditional_set(kind: str = "kind", value: str = "value") -> list[Column]:
    """Ordinary and estimated sums and the number of ordinary entries."""
    k, v = F.col(kind), F.col(value)
    zero = F.lit(0).cast("decimal(18,2)")
    return [
        F.coalesce(F.sum(F.when(is_ordinary(k), v).otherwise(zero)), zero).cast("double").alias("ordinary_sum"),
        F.coalesce(F.sum(F.when(is_estimate(k), v).otherwise(zero)), zero).cast("double").alias("estimate_sum"),
        F.count_if(is_ordinary(k)).alias("n_ordinary"),
    ]


def spend_by(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys).agg(*conditional_set())


def panel_metrics() -> list[Column]:
    k = F.col("kind")
    return [
        F.count("*").alias("n_entries"),
        F.countDistinct("payee_id").alias("n_payees"),
        F.countDistinct(F.when(is_ordinary(k), F.col("payee_id"))).alias("n_ordinary_payees"),
        F.countDistinct("unit").alias("n_units"),
        F.sum("value").cast("double").alias("total"),
        F.min("entry_date").cast("string").alias("first_date"),
        F.max("entry_date").cast("string").alias("last_date"),
        *conditional_set(),
    ]


def by_term(yearly: DataFrame, ongoing_from: int) -> DataFrame:
    """Yearly sums rolled up to four-year terms; implausible years are left out."""
    rows = yearly.filter(F.col("fiscal_year").between(1990, 2100)).withColumn("term", term_start(F.col("fiscal_year")))
    out = rows.groupBy("term").agg(
        F.sum(F.col("ordinary_sum").cast("decimal(18,2)")).cast("double").alias("ordinary_sum"),
        F.array_join(F.array_sort(F.collect_set("fiscal_year")), ",").alias("years"),
    )
    return out.select("term", term_label(F.col("term")).alias("label"), "ordinary_sum", "years", (F.col("term") + 3 >= ongoing_from).alias("ongoing"))


def concentration(entries: DataFrame, keys: list[str], payee: str = "payee_id", value: str = "value") -> DataFrame:
    """Share-based concentration index of the payees of each group, and its band."""
    paid = entries.groupBy(*keys, payee).agg(F.sum(value).cast("double").alias("v")).filter("v > 0")
    share = 100 * F.col("v") / F.sum("v").over(Window.partitionBy(*keys))
    rows = paid.withColumn("share", share)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_payees"), half_up(F.max("share"), 1).alias("top_share"), half_up(F.sum(F.col("share") * F.col("share"))).cast("bigint").alias("hhi")
    )
    return out.withColumn("band", F.when(F.col("hhi") < 1500, "low").when(F.col("hhi") < 2500, "moderate").otherwise("high"))


def year_jump(totals: DataFrame, keys: list[str], year: str, value: str, factor: float, least: float) -> DataFrame:
    """Groups whose total is a multiple of the calendar year before; a gap never matches."""
    before = totals.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias("previous"))
    return totals.join(before, [*keys, year]).filter((F.col("previous") > 0) & (F.col(value) >= factor * F.col("previous")) & (F.col(value) >= least))


def top_share(entries: DataFrame, keys: list[str], who: str, n: int) -> DataFrame:
    """Share of the ``n`` largest payees of each group."""
    paid = entries.groupBy(*keys, who).agg(F.sum("value").alias("v"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), who))
    out = paid.withColumn("rank", rank).groupBy(*keys).agg(
        F.count("*").alias("n_payees"), F.sum("v").cast("double").alias("total"), F.sum(F.when(F.col("rank") <= n, F.col("v"))).cast("double").alias("top_total")
    )
    return out.withColumn("top_percent", half_up(100 * F.col("top_total") / F.col("total"), 1))
