"""Detectors with one finding schema, their consolidation and life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
FINDING = ("detector", "key", "category", "year", "severity", "metric", "value", "reference")


def finding(rows: DataFrame, detector: str, key: Column, category: Column, year: Column, severity: Column, metric: str, value: Column, reference: Column) -> DataFrame:
    """Rows of any detector in the common schema."""
    return rows.select(
        F.lit(detector).alias("detector"), key.cast("string").alias("key"), category.cast("string").alias("category"), year.cast("int").alias("year"),
        severity.alias("severity"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), reference.cast("double").alias("reference"),
    )


def payee_concentration(entries: DataFrame, least_share: float, least_value: float, least_payees: int) -> DataFrame:
    """Payees that take a large share of a unit's year."""
    paid = entries.groupBy("unit", "fiscal_year", "payee_id").agg(F.sum("value").cast("double").alias("v"))
    w = Window.partitionBy("unit", "fiscal_year")
    rows = paid.withColumns({"share": F.col("v") / F.sum("v").over(w), "n": F.count("*").over(w)}).filter((F.col("share") >= least_share) & (F.col("v") >= least_value) & (F.col("n") >= least_payees))
    severity = F.when(F.col("share") >= 2 * least_share, "high").otherwise("medium")
    return finding(rows, "payee-concentration", F.concat_ws("|", "unit", "fiscal_year", "payee_id"), F.col("unit"), F.col("fiscal_year"), severity, "share", F.floor(F.col("share") * 10_000 + 0.5) / 10_000, F.lit(least_share))


def relevant_value(entries: DataFrame, least: float) -> DataFrame:
    """Units whose year sums to a relevant value."""
    rows = entries.groupBy("unit", "fiscal_year").agg(F.sum("value").cast("double").alias("v")).filter(F.col("v") >= least)
    return finding(rows, "relevant-value", F.concat_ws("|", "unit", "fiscal_year"), F.col("unit"), F.col("fiscal_year"), F.lit("low"), "sum", F.col("v"), F.lit(least))


def valid(findings: DataFrame) -> DataFrame:
    """Findings that name their object, metric and period, with a known severity."""
    return findings.filter(F.col("key").isNotNull() & F.col("metric").isNotNull() & F.col("year").isNotNull() & F.col("severity").isin(*SEVERITIES))


def consolidated(findings: DataFrame) -> DataFrame:
    """One theme a category and year: the highest severity, the detectors and how many findings."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    out = findings.groupBy("category", "year").agg(
        F.max(rank).alias("rank"), F.array_join(F.array_sort(F.collect_set("detector")), ",").alias("detectors"), F.count("*").alias("n_findings"), F.max("value").alias("highest")
    )
    return out.select("category", "year", F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("rank") - 1).cast("int")).alias("severity"), "detectors", "n_findings", "highest")


def lifecycle(known: DataFrame, emitted: DataFrame, terminal: tuple[str, ...] = ("dismissed", "confirmed")) -> DataFrame:
    """The state of every finding after a run.

    ``known``: key, evidence, state; ``emitted``: key, evidence. A terminal state
    stays while the evidence does; new evidence reopens; what is no longer
    emitted is retired unless its state is terminal.
    """
    old = known.select("key", F.col("evidence").alias("was"), "state")
    both = old.join(emitted.select("key", F.col("evidence").alias("now")), "key", "full_outer")
    state = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), F.when(F.col("state").isin(*terminal), F.col("state")).otherwise("retired"))
        .when(F.col("was") != F.col("now"), "reopened")
        .otherwise(F.col("state"))
    )
    return both.select("key", state.alias("state"))


def above_contract(citations: DataFrame, contracts: DataFrame, process: str, value: str, contract_value: str, factor: float, excess: float) -> DataFrame:
    """Processes whose cited commitments sum to well above the contract."""
    sums = citations.groupBy(process).agg(F.sum(value).alias("committed"))
    rows = sums.join(contracts, process)
    return rows.filter((F.col("committed") > factor * F.col(contract_value)) & (F.col("committed") - F.col(contract_value) >= excess))


def coverage(listed: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """Listed records found or absent, by group; the group without a value stands last."""
    have = found.select(key).distinct().withColumn("_hit", F.lit(1))
    rows = listed.join(have, key, "left").groupBy(by).agg(F.count("*").alias("listed"), F.count("_hit").alias("found"))
    return rows.select(by, "listed", "found", (F.col("listed") - F.col("found")).alias("absent"), F.floor(100 * F.col("found") / F.col("listed") + 0.5).cast("bigint").alias("percent"))


def revalidated(rows: DataFrame, text: str, urls: str) -> DataFrame:
    """Adds codes of what is pending and the advice: block, check or ok.

    No evidence and accusing words block; a missing source and a placeholder
    left in the text ask for a check.
    """
    t, u = F.col(text), F.col(urls)
    blocks = {"no-evidence": F.size(u) == 0, "accusation": F.lower(t).rlike("fraud|corrupt|crime|theft")}
    checks = {"no-source": F.exists(u, lambda x: F.coalesce(~x.rlike("^https?://"), F.lit(True))), "placeholder": t.rlike(r"_{3,}|X{4,}|\.{5,}")}
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in (blocks | checks).items()]))
    hit = lambda of: F.exists("codes", lambda c: c.isin(*of))
    return rows.withColumn("codes", codes).withColumn("advice", F.when(hit(blocks), "block").when(hit(checks), "check").otherwise("ok"))


BLOCK, ATTENTION, INFO = "block", "attention", "info"


def pending_codes(rows: DataFrame) -> DataFrame:
    """Adds ``pending`` (code, gravity) of each finding and the advice: block, check or ok.

    Columns: text; urls (one array of addresses for each piece of evidence); origin,
    reasons, state, factual, kind, investigated, gate (strings, reasons an array, investigated a
    boolean), value and period. Null stands for nothing known.
    """
    http = lambda urls: F.exists(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.coalesce(u.rlike("(?i)^https?://"), F.lit(False)))
    urls, n = F.coalesce("urls", F.array().cast("array<array<string>>")), F.coalesce(F.size("urls"), F.lit(0))
    bare = F.size(F.filter(urls, lambda u: ~http(u)))
    text = F.coalesce("text", F.lit(""))
    published = F.coalesce(F.col("state") == "published", F.lit(False))
    ungated = published & ~F.coalesce(F.col("factual") == "passed", F.lit(False))
    codes = (
        ("no-evidence", BLOCK, n <= 0),
        ("no-source", BLOCK, (n > 0) & (bare == n)),
        ("no-source", ATTENTION, (bare > 0) & (bare < n)),
        ("placeholder", BLOCK, text.rlike(r"_{3,}|X{4,}|\.{5,}")),
        ("accusation", BLOCK, F.lower(text).rlike("fraud|corrup|desvi[oa]|crim|furto|roub|theft")),
        ("ai-only-risk", ATTENTION, F.col("origin") == "ai-risk"),
        ("legacy", ATTENTION, F.array_contains("reasons", "legacy")),
        ("published-without-gate", ATTENTION, ungated),
        ("not-investigated", INFO, ~ungated & (F.col("kind") == "factual") & ~F.coalesce("investigated", F.lit(False))),
        ("gate-failed", ATTENTION, F.col("gate") == "failed"),
        ("value-without-period", ATTENTION, F.col("value").isNotNull() & F.col("period").isNull()),
    )
    pending = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(gravity).alias("gravity"))) for code, gravity, c in codes]))
    has = lambda g: F.exists("pending", lambda p: p["gravity"] == g)
    return rows.withColumn("pending", pending).withColumn("advice", F.when(has(BLOCK), "block").when(has(ATTENTION), "check").otherwise("ok"))


def may_publish(version: Column, ticked: Column, required: list[str], pending: Column) -> Column:
    """Only findings of deterministic versions are held back, until all fields are ticked and nothing is pending."""
    complete = (F.size(F.array_except(F.array(*map(F.lit, required)), ticked)) == 0) & (pending == 0)
    return ~version.startswith("deterministic") | complete
