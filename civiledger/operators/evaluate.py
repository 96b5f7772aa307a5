"""Evaluation of answers: citations, amounts, refusals, gates and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that accuse.
ACCUSING = ("fraud", "corruption", "crime", "theft")


def valid_citations(citations: DataFrame, context: DataFrame, least: int = 10) -> DataFrame:
    """citations (query, doc, quote, url) and whether each is of the query's context (query, doc, text, url): long enough, found in the text, of the same address."""
    c = context.withColumnRenamed("url", "_url").withColumnRenamed("text", "_text")
    joined = citations.join(c, ["query", "doc"], "left")
    good = (F.length("quote") >= least) & F.contains("_text", "quote") & F.col("url").eqNullSafe(F.col("_url"))
    return joined.withColumn("valid", F.coalesce(good, F.lit(False))).drop("_url", "_text")


def invented(amounts_said: Column, amounts_known: Column) -> Column:
    return F.array_except(amounts_said, amounts_known)


def accusing(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.lower(text).contains(w), F.lit(w)) for w in ACCUSING]))


def fact_coverage(text: Column, facts: Column) -> Column:
    """Share of the facts that the text says; null without any."""
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: F.contains(F.lower(text), F.lower(f)))) / F.size(facts))


def gate(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """metric, passed for each threshold: a value that is missing fails."""
    table = metrics.sparkSession.createDataFrame(sorted(least.items()), "metric string, least double")
    return table.join(metrics, "metric", "left").select("metric", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)).alias("passed"))


def compared_reports(now: DataFrame, before: DataFrame, lower_is_better: tuple[str, ...], tolerance: float) -> DataFrame:
    """metric, verdict: a value that is gone is worse, a new one better."""
    joined = now.select("metric", F.col("value").alias("a")).join(before.select("metric", F.col("value").alias("b")), "metric", "full_outer")
    gain = (F.col("a") - F.col("b")) * F.when(F.col("metric").isin(*lower_is_better), -1).otherwise(1)
    lost, new = F.col("a").isNull() & F.col("b").isNotNull(), F.col("b").isNull() & F.col("a").isNotNull()
    return joined.select("metric", F.when(lost, "worse").when(new, "better").when(gain > tolerance, "better").when(gain < -tolerance, "worse").otherwise("equal").alias("verdict"))
