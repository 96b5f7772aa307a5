"""Aggregates: spending, panels, concentration, growth, reconciliation and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import week_of_year
from ..functions.money import half_up
from ..operators import quality, rules, spend, windows
from ..sources.tables import ledger, table
from .registering import CONDITIONAL, LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
CATEGORIES = [("3", "current"), ("3.1", "personnel"), ("3.3", "running"), ("3.3.1", "travel"), ("4", "capital"), ("4.2", "works")]
#: A dotted code for parts, in the shape of category codes.
_CODE = "concat_ws('.', CAST(3 + p_partkey % 3 AS STRING), CAST(1 + p_size % 4 AS STRING), CAST(p_partkey % 5 AS STRING))"


@_R.add(f"SELECT fiscal_year, {CONDITIONAL} FROM {LEDGER} GROUP BY fiscal_year")
def spend_by_year_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.spend_by(ledger(spark, sf_dir), "fiscal_year")


@_R.add(f"SELECT unit, fiscal_year, {CONDITIONAL} FROM {LEDGER} GROUP BY unit, fiscal_year")
def spend_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.spend_by(ledger(spark, sf_dir), "unit", "fiscal_year")


def _coded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


_CODE_SQL = "concat_ws('.', CAST(3 + p_partkey % 3 AS VARCHAR), CAST(1 + p_size % 4 AS VARCHAR), CAST(p_partkey % 5 AS VARCHAR))"
_CODED = f"(SELECT {_CODE_SQL} AS code, CAST(l_extendedprice AS DECIMAL(18,2)) AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"


@_R.add(f"SELECT code, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM {_CODED} WHERE code LIKE '3.1%' OR code LIKE '4.%' GROUP BY code")
def spend_by_category_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _coded_lines(spark, sf_dir).filter(F.col("code").startswith("3.1") | F.col("code").startswith("4."))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


@_R.add(f"""
WITH p(prefix, name) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in CATEGORIES)}),
m AS (SELECT code, arg_max(name, length(prefix)) AS category FROM (SELECT DISTINCT code FROM {_CODED}) c JOIN p ON code = prefix OR code LIKE prefix || '.%' GROUP BY code)
SELECT category, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM {_CODED} LEFT JOIN m USING (code) GROUP BY category""")
def reclassified_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_code = _coded_lines(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rules.longest_prefix(by_code, "code", CATEGORIES).groupBy("category").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


_PANEL = f"""count(*) AS n_entries, count(DISTINCT payee_id) AS n_payees,
 count(DISTINCT CASE WHEN coalesce(kind, '') NOT ILIKE 'P%' AND coalesce(kind, '') NOT ILIKE 'O%' THEN payee_id END) AS n_ordinary_payees,
 count(DISTINCT unit) AS n_units, CAST(sum(value) AS DOUBLE) AS total, CAST(min(entry_date) AS VARCHAR) AS first_date,
 CAST(max(entry_date) AS VARCHAR) AS last_date, {CONDITIONAL}"""


@_R.add(f"SELECT fiscal_year, {_PANEL} FROM {LEDGER} GROUP BY fiscal_year")
def year_panel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("fiscal_year").agg(*spend.panel_metrics())


@_R.add(f"SELECT {_PANEL} FROM {LEDGER}")
def grand_total_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).agg(*spend.panel_metrics())


@_R.add()
def approx_distinct_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("fiscal_year").agg(F.approx_count_distinct("payee_id", 0.02).alias("n_payees"))


@_R.add(f"""
SELECT term, term || '-' || (term + 3) AS label, CAST(sum(s) AS DOUBLE) AS ordinary_sum, array_to_string(list_sort(list(y)), ',') AS years, term + 3 >= 2001 AS ongoing
FROM (SELECT fiscal_year AS y, CAST(2025 + floor((fiscal_year - 2025) / 4.0) * 4 AS INT) AS term,
  sum(CASE WHEN kind NOT ILIKE 'P%' AND kind NOT ILIKE 'O%' THEN value ELSE 0 END) AS s FROM {LEDGER} GROUP BY fiscal_year) GROUP BY term""")
def term_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.by_term(spend.spend_by(ledger(spark, sf_dir), "fiscal_year"), 2001)


def _payee_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("payee_id", "fiscal_year").agg(F.sum("value").cast("double").alias("total"))


_PAYEE_YEARS = f"(SELECT payee_id, fiscal_year, CAST(sum(value) AS DOUBLE) AS total FROM {LEDGER} GROUP BY payee_id, fiscal_year)"


@_R.add(f"""
SELECT payee_id, fiscal_year, total, previous, CASE WHEN previous > 0 THEN CAST(floor(100 * (total - previous) / previous + 0.5) AS BIGINT) END AS growth_percent
FROM (SELECT *, lag(total) OVER (PARTITION BY payee_id ORDER BY fiscal_year) AS previous FROM {_PAYEE_YEARS})""")
def payee_yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _payee_years(spark, sf_dir).withColumn("previous", F.lag("total").over(Window.partitionBy("payee_id").orderBy("fiscal_year")))
    growth = F.when(F.col("previous") > 0, F.floor(100 * (F.col("total") - F.col("previous")) / F.col("previous") + 0.5).cast("bigint"))
    return rows.withColumn("growth_percent", growth)


@_R.add(f"""
SELECT a.payee_id, a.fiscal_year, a.total, b.total AS previous FROM {_PAYEE_YEARS} a JOIN {_PAYEE_YEARS} b ON a.payee_id = b.payee_id AND a.fiscal_year = b.fiscal_year + 1
WHERE b.total > 0 AND a.total >= 3 * b.total AND a.total >= 50000""")
def category_year_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.year_jump(_payee_years(spark, sf_dir), ["payee_id"], "fiscal_year", "total", 3, 50_000)


@_R.add(f"""
WITH v AS (SELECT fiscal_year, c_nationkey, payee_id, CAST(sum(value) AS DOUBLE) AS v FROM {LEDGER} JOIN customer ON payee_id = c_custkey GROUP BY ALL),
s AS (SELECT *, 100 * v / sum(v) OVER (PARTITION BY fiscal_year, c_nationkey) AS share FROM v WHERE v > 0)
SELECT fiscal_year, c_nationkey, count(*) AS n_payees, floor(max(share) * 10 + 0.5) / 10 AS top_share, CAST(floor(sum(share * share) + 0.5) AS BIGINT) AS hhi,
 CASE WHEN floor(sum(share * share) + 0.5) < 1500 THEN 'low' WHEN floor(sum(share * share) + 0.5) < 2500 THEN 'moderate' ELSE 'high' END AS band
FROM s GROUP BY fiscal_year, c_nationkey""")
def payee_hhi_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    payees = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("payee_id"), "c_nationkey")
    return spend.concentration(ledger(spark, sf_dir).join(payees, "payee_id"), ["fiscal_year", "c_nationkey"])


_STATS = """count(*) AS n, floor(avg(v) * 100 + 0.5) / 100 AS mean, floor(sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) * 100 + 0.5) / 100 AS deviation"""


@_R.add(f"SELECT p_type, {_STATS}, min(v) AS low, max(v) AS high FROM (SELECT p_type, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_type")
def group_stats_population_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return windows.group_stats(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), ["p_type"], "l_extendedprice")


@_R.add(f"""
WITH s AS (SELECT event_type, {_STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY event_type)
SELECT event_id, event_type, value, floor((value - mean) / deviation * 100 + 0.5) / 100 AS z FROM events JOIN s USING (event_type)
WHERE deviation > 0 AND floor((value - mean) / deviation * 100 + 0.5) / 100 >= 2.5""")
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.outliers(table(spark, sf_dir, "events"), ["event_type"], "value", 2.5).select("event_id", "event_type", "value", "z")


@_R.add(f"""
SELECT payee_id, fiscal_year, week, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total
FROM (SELECT *, CAST(strftime(entry_date, '%W') AS INT) AS week FROM {LEDGER}) WHERE value < 150000 GROUP BY payee_id, fiscal_year, week HAVING count(*) >= 2 AND sum(value) > 150000""")
def weekly_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).filter("value < 150000").withColumn("week", week_of_year(F.col("entry_date")))
    out = rows.groupBy("payee_id", "fiscal_year", "week").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.filter("n >= 2 AND total > 150000").withColumn("total", F.col("total").cast("double"))


_PRICE = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price FROM lineitem WHERE l_quantity > 0)"


@_R.add(f"""
WITH p AS {_PRICE}, m AS (SELECT l_partkey, median(CAST(price AS DOUBLE)) AS mid, count(*) AS n FROM p GROUP BY l_partkey),
s AS (SELECT l_partkey, avg(CASE WHEN abs(price - mid) <= 0.3 * mid THEN 1.0 ELSE 0.0 END) AS near FROM p JOIN m USING (l_partkey) GROUP BY l_partkey)
SELECT l_partkey, count(*) AS n_high, max(CAST(price AS DOUBLE)) AS highest, max(mid) AS mid FROM p JOIN m USING (l_partkey) JOIN s USING (l_partkey)
WHERE n >= 4 AND near >= 0.2 AND CAST(price AS DOUBLE) >= 3 * mid GROUP BY l_partkey""")
def median_price_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 0").select("l_partkey", half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"))
    mid = lines.groupBy("l_partkey").agg(F.percentile("price", 0.5).alias("mid"), F.count("*").alias("n"))
    rows = lines.join(mid, "l_partkey")
    near = F.avg(F.when(F.abs(F.col("price") - F.col("mid")) <= 0.3 * F.col("mid"), 1.0).otherwise(0.0))
    high = F.col("price") >= 3 * F.col("mid")
    out = rows.groupBy("l_partkey", "n", "mid").agg(near.alias("near"), F.count_if(high).alias("n_high"), F.max("price").alias("highest"))
    return out.filter("n >= 4 AND near >= 0.2 AND n_high > 0").select("l_partkey", "n_high", "highest", "mid")


@_R.add(f"""
SELECT fiscal_year, n_payees, total, top_total, floor(1000 * top_total / total + 0.5) / 10 AS top_percent FROM (
 SELECT fiscal_year, count(*) AS n_payees, CAST(sum(v) AS DOUBLE) AS total, CAST(sum(CASE WHEN r <= 5 THEN v END) AS DOUBLE) AS top_total FROM (
  SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY v DESC, payee_id) AS r FROM (SELECT fiscal_year, payee_id, sum(value) AS v FROM {LEDGER} GROUP BY ALL)) GROUP BY fiscal_year)""")
def concentration_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend.top_share(ledger(spark, sf_dir), ["fiscal_year"], "payee_id", 5)


@_R.add(f"""
SELECT unit, {", ".join(f"CAST(coalesce(sum(CASE WHEN fiscal_year = {y} THEN value END), 0) AS DOUBLE) AS y{y}" for y in range(1995, 2002))} FROM {LEDGER} GROUP BY unit""")
def pivot_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = list(range(1995, 2002))
    wide = ledger(spark, sf_dir).groupBy("unit").pivot("fiscal_year", years).agg(F.sum("value"))
    return wide.select("unit", *[F.coalesce(F.col(str(y)), F.lit(0)).cast("double").alias(f"y{y}") for y in years])


@_R.add("""
SELECT lang, field, CAST(sum(m) AS BIGINT) AS n_missing, count(*) AS n_rows, CAST(floor(100.0 * sum(m) / count(*) + 0.5) AS BIGINT) AS percent FROM (
 SELECT lang, 'quality' AS field, CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS m FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT lang, 'text', CASE WHEN nullif(trim(text), '') IS NULL THEN 1 ELSE 0 END FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY lang, field""")
def unpivot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.gaps(rows, ["lang"], {"quality": F.col("quality"), "text": F.nullif(F.trim("text"), F.lit(""))})


@_R.add("""
SELECT CASE WHEN s <= 25 THEN '0-25' WHEN s <= 50 THEN '26-50' WHEN s <= 75 THEN '51-75' ELSE '76-100' END AS band, count(*) AS n
FROM (SELECT least(100, n_chars // 50) AS s FROM documents) GROUP BY 1""")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.bands(table(spark, sf_dir, "documents"), F.least(F.lit(100), F.expr("n_chars div 50")))


@_R.add("""
SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def grouping_sets_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spark.sql("SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n, sum(n_chars) AS chars FROM {docs} GROUP BY GROUPING SETS ((lang, source), (lang), ())", docs=docs)


@_R.add("""
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS stated, CAST(s AS DOUBLE) AS item_sum,
 CASE WHEN s IS NULL THEN 'no match' WHEN abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= 1 OR abs(s - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.05 * CAST(o_totalprice AS DECIMAL(18,2)) THEN 'validated' ELSE 'divergent' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def reconcile_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    totals = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("t"))
    return quality.reconciled(items, totals, "o_orderkey", "v", "t", 1, 0.05)


@_R.add("SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@_R.add(f"SELECT payee_id, array_to_string(list_sort(list(DISTINCT fiscal_year)), ',') AS years, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM {LEDGER} GROUP BY payee_id HAVING count(*) >= 5 AND sum(value) > 500000")
def string_lists_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).groupBy("payee_id").agg(
        F.array_join(F.array_sort(F.collect_set("fiscal_year")), ",").alias("years"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"), F.sum("value").alias("v")
    )
    return rows.filter("n >= 5 AND v > 500000").select("payee_id", "years", "kinds")


@_R.add(f"SELECT fiscal_year, unit AS heaviest_unit, n FROM (SELECT *, row_number() OVER (PARTITION BY fiscal_year ORDER BY n DESC, unit) AS r FROM (SELECT fiscal_year, unit, count(*) AS n FROM {LEDGER} GROUP BY ALL)) WHERE r = 1")
def arg_max_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ledger(spark, sf_dir).groupBy("fiscal_year", "unit").agg(F.count("*").alias("n"))
    return windows.latest_row(counts, ["fiscal_year"], F.desc("n"), F.col("unit")).select("fiscal_year", F.col("unit").alias("heaviest_unit"), "n")


@_R.add("""
SELECT l_partkey, CAST(year(l_shipdate) AS INT) AS y, floor(avg(p) * 100 + 0.5) / 100 AS mean_price, min(p) AS low, max(p) AS high
FROM (SELECT *, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS p FROM lineitem WHERE l_quantity > 0) GROUP BY 1, 2""")
def price_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    p = half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    return rows.groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(half_up(F.avg(p), 2).alias("mean_price"), F.min(p).alias("low"), F.max(p).alias("high"))
