"""Detectors, their consolidation and life cycle, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_CONCENTRATION = f"""SELECT 'payee-concentration' AS detector, unit || '|' || fiscal_year || '|' || payee_id AS key, unit AS category, fiscal_year AS year, CASE WHEN v / s >= 0.02 THEN 'high' ELSE 'medium' END AS severity,
 'share' AS metric, floor(v / s * 10000 + 0.5) / 10000 AS value, CAST(0.01 AS DOUBLE) AS reference FROM (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS n FROM (
 SELECT unit, fiscal_year, payee_id, CAST(sum(value) AS DOUBLE) AS v FROM {LEDGER} GROUP BY ALL) WINDOW w AS (PARTITION BY unit, fiscal_year)) WHERE v / s >= 0.01 AND v >= 50000 AND n >= 4"""
_RELEVANT = f"""SELECT 'relevant-value' AS detector, unit || '|' || fiscal_year AS key, unit AS category, fiscal_year AS year, 'low' AS severity, 'sum' AS metric, CAST(sum(value) AS DOUBLE) AS value, CAST(500000 AS DOUBLE) AS reference
 FROM {LEDGER} GROUP BY unit, fiscal_year HAVING sum(value) >= 500000"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    return detect.valid(detect.payee_concentration(rows, 0.01, 50_000, 4).unionByName(detect.relevant_value(rows, 500_000)))


@_R.add(f"{_CONCENTRATION} UNION ALL {_RELEVANT}")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


@_R.add(f"""
SELECT category, year, CASE max(CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) WHEN 2 THEN 'low' WHEN 3 THEN 'medium' ELSE 'high' END AS severity,
 array_to_string(list_sort(list(DISTINCT detector)), ',') AS detectors, count(*) AS n_findings, max(value) AS highest FROM ({_CONCENTRATION} UNION ALL {_RELEVANT}) GROUP BY category, year""")
def findings_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.consolidated(_findings(spark, sf_dir))


@_R.add("""
WITH k AS (SELECT event_id AS key, value AS e, CASE WHEN event_id % 4 = 0 THEN 'dismissed' ELSE 'new' END AS s FROM events WHERE event_id % 10 < 8),
m AS (SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS e FROM events WHERE event_id % 10 > 1)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN k.key IS NULL THEN 'new' WHEN m.key IS NULL THEN CASE WHEN s = 'dismissed' THEN s ELSE 'retired' END WHEN k.e <> m.e THEN 'reopened' ELSE s END AS state FROM k FULL JOIN m USING (key)) GROUP BY state""")
def finding_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a run, with findings made from the events: some gone, some new, some with new evidence."""
    e = table(spark, sf_dir, "events")
    known = e.filter("event_id % 10 < 8").select(F.col("event_id").alias("key"), F.col("value").alias("evidence"), F.when(F.col("event_id") % 4 == 0, "dismissed").otherwise("new").alias("state"))
    new = F.when(F.col("event_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))
    emitted = e.filter("event_id % 10 > 1").select(F.col("event_id").alias("key"), new.alias("evidence"))
    return detect.lifecycle(known, emitted).groupBy("state").agg(F.count("*").alias("n"))


@_R.add("""
SELECT o_orderkey, CAST(c AS DOUBLE) AS committed, CAST(v AS DOUBLE) AS contract FROM (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS c FROM lineitem GROUP BY 1)
JOIN (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders) ON l_orderkey = o_orderkey WHERE c > 1.25 * v AND c - v >= 10000""")
def commitments_above_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    contracts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("contract"))
    out = detect.above_contract(cited, contracts, "o_orderkey", "v", "contract", 1.25, 10_000)
    return out.select("o_orderkey", F.col("committed").cast("double").alias("committed"), F.col("contract").cast("double").alias("contract"))


@_R.add("""
SELECT lang, count(*) AS listed, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS absent, CAST(floor(100.0 * count(l.doc_id) / count(*) + 0.5) AS BIGINT) AS percent
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang""")
def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "lang")
