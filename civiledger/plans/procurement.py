"""Procurement, payroll, earmarks and council queries, with the driver's tables in the roles of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import procure
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_MONEY = "decimal(18,2)"


@_R.add(f"""
WITH k AS (SELECT fiscal_year, unit, count(*) AS n, count(*) FILTER (WHERE kind = 'F') AS closed, count(*) FILTER (WHERE kind = 'O') AS open, count(*) FILTER (WHERE value > 200000) AS large,
 count(*) FILTER (WHERE payee_id % 10 = 0) AS exempt, sum(value) AS v, sum(CASE WHEN kind = 'F' THEN value ELSE 0 END) AS f FROM {LEDGER} GROUP BY ALL)
SELECT fiscal_year, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(closed) AS BIGINT) AS n_closed, CAST(sum(open) AS BIGINT) AS n_open, CAST(sum(large) AS BIGINT) AS n_large, CAST(sum(exempt) AS BIGINT) AS n_exempt,
 CAST(sum(v) AS DOUBLE) AS estimated, CAST(sum(f) AS DOUBLE) AS final, string_agg(unit || '=' || n, ',' ORDER BY unit || '=' || n) AS by_modality FROM k GROUP BY fiscal_year""")
def procurement_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("kind"), F.col("value")
    flags = {"n_closed": k == "F", "n_open": k == "O", "n_large": v > 200_000, "n_exempt": F.col("payee_id") % 10 == 0}
    return procure.yearly_statistics(ledger(spark, sf_dir), "fiscal_year", "unit", flags, {"estimated": v, "final": F.when(k == "F", v).otherwise(F.lit(0).cast(_MONEY))})


@_R.add(f"""
WITH i AS (SELECT l_orderkey AS entry_id, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS items, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT fiscal_year, CAST(sum(coalesce(items, value)) AS DOUBLE) AS estimated, CAST(sum(CASE WHEN kind = 'F' THEN coalesce(items, value) END) AS DOUBLE) AS final, count(*) FILTER (WHERE items IS NULL) AS n_without_items,
 CAST(floor(100.0 * count(items) / count(*) + 0.5) AS BIGINT) AS coverage FROM {LEDGER} LEFT JOIN i USING (entry_id) GROUP BY fiscal_year""")
def annual_procurement_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by the best source, and what lacks items."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")
    items = lines.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.sum(F.col("l_extendedprice").cast(_MONEY)).alias("items"))
    rows = ledger(spark, sf_dir).join(items, "entry_id", "left").withColumn("best", F.coalesce("items", "value"))
    return rows.groupBy("fiscal_year").agg(F.sum("best").cast("double").alias("estimated"), F.sum(F.when(F.col("kind") == "F", F.col("best"))).cast("double").alias("final"),
        F.count_if(F.col("items").isNull()).alias("n_without_items"), F.floor(100 * F.count("items") / F.count("*") + 0.5).alias("coverage"))


@_R.add(f"SELECT unit, count(*) AS n, CAST(min(CASE WHEN kind = 'F' THEN fiscal_year END) AS INT) AS first_year, CAST(max(CASE WHEN kind = 'F' THEN fiscal_year END) AS INT) AS last_year, CAST(sum(value) AS DOUBLE) AS total FROM {LEDGER} GROUP BY unit")
def panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.when(F.col("kind") == "F", F.col("fiscal_year"))
    return ledger(spark, sf_dir).groupBy("unit").agg(F.count("*").alias("n"), F.min(closed).alias("first_year"), F.max(closed).alias("last_year"), F.sum("value").cast("double").alias("total"))


@_R.add("""
SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (WHERE status = 'quarantine') AS n_quarantine, count(*) FILTER (WHERE status = 'context') AS n_context, CAST(coalesce(sum(CASE WHEN status <> 'quarantine' THEN v END), 0) AS DOUBLE) AS total
FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS v, CASE WHEN l_extendedprice > 95000 OR (p > 0 AND l_extendedprice > 1.05 * p) THEN 'quarantine' WHEN coalesce(p, 0) = 0 THEN 'context' ELSE 'release' END AS status
FROM lineitem LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 4 END AS p FROM orders) ON l_orderkey = o_orderkey) GROUP BY l_orderkey""")
def item_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each process by what the gate says of them; sums leave out what is in quarantine."""
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 4 END").alias("p"))
    items = procure.quarantined(table(spark, sf_dir, "lineitem").join(totals, "l_orderkey", "left"), "p", "l_extendedprice", 95_000)
    kept = F.when(F.col("status") != "quarantine", F.col("l_extendedprice").cast(_MONEY))
    return items.groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.count_if(F.col("status") == "quarantine").alias("n_quarantine"), F.count_if(F.col("status") == "context").alias("n_context"),
        F.coalesce(F.sum(kept).cast("double"), F.lit(0.0)).alias("total"))


@_R.add("""
SELECT l_orderkey, l_suppkey, CAST(won AS DOUBLE) AS won, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY won DESC, n DESC, l_suppkey) AS k FROM
 (SELECT l_orderkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS won, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def winners_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast(_MONEY).alias("v"))
    return procure.winners(rows, "l_orderkey", "l_suppkey", "v").withColumn("won", F.col("won").cast("double"))


@_R.add(f"""
SELECT unit, fiscal_year, payee_id, CAST(won AS DOUBLE) AS won, n FROM (SELECT *, row_number() OVER (PARTITION BY unit, fiscal_year ORDER BY won DESC, n DESC, payee_id) AS k FROM
 (SELECT unit, fiscal_year, payee_id, sum(value) AS won, count(*) AS n FROM {LEDGER} WHERE kind <> 'P' GROUP BY 1, 2, 3)) WHERE k = 1""")
def winners_from_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).filter("kind <> 'P'").withColumn("document", F.struct("unit", "fiscal_year"))
    return procure.winners(rows, "document", "payee_id", "value").select("document.unit", "document.fiscal_year", "payee_id", F.col("won").cast("double").alias("won"), "n")


@_R.add("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS closed, l_returnflag = 'A' AS cancelled, l_suppkey % 2 AS supplier, CASE WHEN l_tax > 0.01 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (WHERE closed) AS n_closed, CASE WHEN count(DISTINCT CASE WHEN closed AND NOT cancelled THEN supplier END) = 1 THEN min(CASE WHEN closed AND NOT cancelled THEN supplier END) END AS winner,
 CASE WHEN bool_and(closed AND NOT cancelled AND total IS NOT NULL) THEN CAST(sum(total) AS DOUBLE) END AS total, CAST(max(CASE WHEN NOT cancelled THEN day END) AS VARCHAR) AS result_day FROM i GROUP BY l_orderkey""")
def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items with one result each, some open, cancelled or without a total."""
    result = F.struct((F.col("l_suppkey") % 2).alias("supplier"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice")).alias("total"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "A").alias("cancelled"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linestatus") == "F").alias("closed"), F.array(result).alias("results"))
    return procure.consolidated_results(items, "l_orderkey")


@_R.add("""
WITH p AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'MACHINERY' ELSE c_mktsegment END AS department, c_custkey AS registration, c_nationkey % 3 AS bond, CAST(c_acctbal AS DECIMAL(18,2)) AS gross, 2020 + c_custkey % 2 AS year, 9 + c_custkey % 5 AS month FROM customer)
SELECT department, count(DISTINCT (bond, registration)) AS n_people, CAST(sum(gross) AS DOUBLE) AS gross FROM p WHERE (year, month) = (SELECT (year, month) FROM p WHERE month <= 12 ORDER BY year DESC, month DESC LIMIT 1) GROUP BY department""")
def payroll_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as payroll rows; month 13 is no regular one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("department"), F.col("c_custkey").alias("registration"), (F.col("c_nationkey") % 3).alias("bond"),
        F.col("c_acctbal").cast(_MONEY).alias("gross"), (2020 + F.col("c_custkey") % 2).alias("year"), (9 + F.col("c_custkey") % 5).alias("month"))
    return procure.payroll_by_department(rows, {"BUILDING": "MACHINERY"})


_EARMARKS = f"(SELECT *, CASE WHEN payee_id % 3 = 0 THEN 'federal' WHEN payee_id % 3 = 1 THEN 'state' ELSE 'local' END AS sphere, CASE WHEN entry_id % 9 > 0 THEN fiscal_year END AS year, payee_id % 20 AS legislator, entry_id // 100 AS number FROM {LEDGER})"


def _earmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = F.col("payee_id") % 3, F.col("entry_id")
    return ledger(spark, sf_dir).select("*", F.when(p == 0, "federal").when(p == 1, "state").otherwise("local").alias("sphere"), F.when(e % 9 > 0, F.col("fiscal_year")).alias("year"),
        (F.col("payee_id") % 20).alias("legislator"), F.floor(e / 100).alias("number"))


@_R.add(f"SELECT sphere, year, count(DISTINCT (number, legislator)) AS n_earmarks, CAST(sum(value) AS DOUBLE) AS total FROM {_EARMARKS} GROUP BY sphere, year")
def earmarks_by_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _earmarks(spark, sf_dir).groupBy("sphere", "year").agg(F.countDistinct("number", "legislator").alias("n_earmarks"), F.sum("value").cast("double").alias("total"))


@_R.add(f"SELECT legislator, count(DISTINCT (sphere, number)) AS n_earmarks, CAST(sum(value) AS DOUBLE) AS total, CAST(min(year) AS INT) AS first_year, CAST(max(year) AS INT) AS last_year FROM {_EARMARKS} GROUP BY legislator")
def earmarks_by_legislator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _earmarks(spark, sf_dir).groupBy("legislator").agg(F.countDistinct("sphere", "number").alias("n_earmarks"), F.sum("value").cast("double").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@_R.add(f"""
SELECT sphere, number, legislator, CAST(sum(value) AS DOUBLE) AS total, arg_max(d, (length(d), d)) AS detail, string_agg(lpad(CAST(entry_id AS VARCHAR), 12, '0'), ',' ORDER BY entry_id) AS parts
FROM (SELECT *, unit || ' ' || kind AS d FROM {_EARMARKS}) GROUP BY sphere, number, legislator""")
def unified_earmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _earmarks(spark, sf_dir).withColumn("detail", F.concat_ws(" ", "unit", "kind")).withColumn("part", F.lpad(F.col("entry_id").cast("string"), 12, "0"))
    return procure.unified_earmarks(rows, ["sphere", "number", "legislator"], "value", "detail", "part")


@_R.add(f"SELECT sphere, CAST(coalesce(sum(CASE WHEN year = 1997 THEN value END), 0) AS DOUBLE) AS of_year, CAST(coalesce(sum(CASE WHEN year IS NOT NULL THEN value END), 0) AS DOUBLE) AS accumulated, CAST(coalesce(sum(CASE WHEN year IS NULL THEN value END), 0) AS DOUBLE) AS without_year FROM {_EARMARKS} GROUP BY sphere")
def sphere_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procure.by_sphere(_earmarks(spark, sf_dir), 1997)


@_R.add(f"""
WITH e AS (SELECT *, payee_id || '/' || fiscal_year AS code FROM {LEDGER} WHERE entry_id % 2 = 0), o AS (SELECT entry_id AS other, payee_id, entry_date, payee_id || '/' || (fiscal_year + entry_id % 4 // 2) AS code FROM {LEDGER} WHERE entry_id % 2 = 1),
x AS (SELECT entry_id, min(other) AS other, 'exact' AS how FROM e JOIN o USING (code) GROUP BY entry_id),
w AS (SELECT e.entry_id, other, 'window' AS how, row_number() OVER (PARTITION BY e.entry_id ORDER BY abs(date_diff('day', o.entry_date, e.entry_date)), other) AS k FROM e JOIN o ON e.payee_id = o.payee_id AND abs(date_diff('day', o.entry_date, e.entry_date)) <= 400 WHERE e.entry_id NOT IN (SELECT entry_id FROM x))
SELECT entry_id, other, how FROM x UNION ALL SELECT entry_id, other, how FROM w WHERE k = 1""")
def cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even entries matched to odd ones: by code, else by payee within 400 days."""
    rows = ledger(spark, sf_dir)
    left = rows.filter("entry_id % 2 = 0").select("entry_id", "payee_id", "entry_date", F.expr("payee_id || '/' || fiscal_year").alias("code"))
    right = rows.filter("entry_id % 2 = 1").select(F.col("entry_id").alias("other"), F.expr("payee_id || '/' || (fiscal_year + (entry_id % 4 DIV 2))").alias("code"), F.col("payee_id").alias("p"), F.col("entry_date").alias("d"))
    gap = F.abs(F.date_diff("d", "entry_date"))
    return procure.cascade(left, right, ["code"], (F.col("payee_id") == F.col("p")) & (gap <= 400), [gap, "other"], "entry_id", "other")


@_R.add(f"""
SELECT entry_id, other FROM (SELECT a.entry_id, b.entry_id AS other, row_number() OVER (PARTITION BY a.entry_id ORDER BY CASE WHEN a.fiscal_year = b.fiscal_year THEN 1 ELSE 0 END DESC, b.entry_date DESC, b.entry_id) AS k
 FROM {LEDGER} a JOIN {LEDGER} b ON a.payee_id = b.payee_id AND b.kind = 'F' WHERE a.kind = 'P') WHERE k = 1""")
def preferred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each payment order the closed entry of its payee: of the same year, else the newest."""
    rows = ledger(spark, sf_dir)
    left = rows.filter("kind = 'P'").select("entry_id", "payee_id", F.col("fiscal_year").alias("year"))
    right = rows.filter("kind = 'F'").select(F.col("entry_id").alias("other"), "payee_id", "fiscal_year", "entry_date")
    newest = F.struct(F.col("entry_date"), -F.col("other"))
    return procure.preferred(left, right, "payee_id", "year", "fiscal_year", newest, "other").select("entry_id", "other")


@_R.add("""
SELECT l_orderkey, l_partkey, l_linenumber, filled FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY filled DESC, l_linenumber) AS k FROM
 (SELECT l_orderkey, l_partkey % 3 AS l_partkey, l_linenumber, CAST(CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS INT) AS filled FROM lineitem)) WHERE k = 1""")
def fullest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda c, x: F.when(c, F.col(x))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("l_partkey"), "l_linenumber", some(F.col("l_tax") > 0.03, "l_tax").alias("a"),
        some(F.col("l_discount") > 0.05, "l_discount").alias("b"), some(F.col("l_returnflag") != "N", "l_returnflag").alias("c"))
    return procure.fullest(rows, ["l_orderkey", "l_partkey"], ["a", "b", "c"], "l_linenumber").select("l_orderkey", "l_partkey", "l_linenumber", "filled")


@_R.add(f"""
SELECT payee_id, fiscal_year, entry_id, role, n_documents FROM (SELECT *, row_number() OVER (PARTITION BY payee_id, fiscal_year ORDER BY CASE role WHEN 'notice' THEN 0 WHEN 'publication' THEN 1 WHEN 'other' THEN 2 ELSE 3 END, entry_date, entry_id) AS k,
 count(*) OVER (PARTITION BY payee_id, fiscal_year) AS n_documents FROM (SELECT *, CASE entry_id % 4 WHEN 0 THEN 'republication' WHEN 1 THEN 'publication' WHEN 2 THEN 'notice' ELSE 'other' END AS role FROM {LEDGER})) WHERE k = 1""")
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as documents of a process by payee and year."""
    title = F.expr("CASE entry_id % 4 WHEN 0 THEN 'Republicação do aviso' WHEN 1 THEN 'Publicação' WHEN 2 THEN 'EDITAL 1' ELSE 'Ata' END")
    return procure.canonical_documents(ledger(spark, sf_dir), ["payee_id", "fiscal_year"], title, "entry_date", "entry_id")


@_R.add("""
WITH c AS (SELECT l_orderkey, l_linenumber, string_agg(name || ':' || choice, ',' ORDER BY name || ':' || choice) AS choices FROM (SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS name, l_returnflag AS choice FROM lineitem) GROUP BY 1, 2)
SELECT o_orderkey AS session, coalesce(n, 0) AS n_votes, digest FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, md5(string_agg(l_orderkey || '-' || l_linenumber || '=' || choices, ';' ORDER BY l_orderkey || '-' || l_linenumber || '=' || choices)) AS digest FROM c WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey""")
def nested_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, their lines after the first as votes with one roll call each."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("session"), F.expr("l_orderkey || '-' || l_linenumber").alias("vote"), F.expr("'s' || l_suppkey").alias("name"), F.col("l_returnflag").alias("choice"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"))
    return procure.nested_votes(sessions, lines.select("session", "vote").distinct(), lines.select("vote", "name", "choice"), "session", "vote")


_AUTHORS = "'Ana Lima, s' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ',  Bo   Sá' ELSE '' END"


@_R.add("""
WITH a AS (SELECT l_orderkey || '-' || l_linenumber AS p, unnest(CASE WHEN l_linenumber % 2 = 0 THEN ['Ana Lima', 's' || l_suppkey, 'Bo Sá'] ELSE ['Ana Lima', 's' || l_suppkey] END) AS author FROM lineitem)
SELECT a.author, b.author AS coauthor, count(*) AS n FROM a JOIN a b USING (p) WHERE a.author <> b.author GROUP BY 1, 2""")
def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey || '-' || l_linenumber").alias("p"), F.expr(_AUTHORS).alias("said"))
    return procure.coauthors(rows, "p", keys.authors(F.col("said"))).groupBy("author", "coauthor").agg(F.count("*").alias("n"))


@_R.add("""
SELECT author, term, count(*) AS n, count(*) FILTER (WHERE solo) AS n_solo, count(*) FILTER (WHERE kind = 'R') AS n_requests FROM (SELECT unnest(CASE WHEN l_linenumber % 2 = 0 THEN ['s' || l_suppkey, 'Bo Sá'] ELSE ['s' || l_suppkey] END) AS author,
 l_linenumber % 2 = 1 AS solo, l_returnflag AS kind, CAST(2025 + floor((year(l_shipdate) - 2025) / 4.0) * 4 AS INT) AS term FROM lineitem) GROUP BY 1, 2""")
def propositions_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.dates import term_start

    names = keys.authors(F.expr("'s' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ',  Bo   Sá' ELSE '' END"))
    rows = table(spark, sf_dir, "lineitem").select(names.alias("a"), "l_returnflag", term_start(F.year("l_shipdate")).alias("term"))
    rows = rows.select(F.explode("a").alias("author"), (F.size("a") == 1).alias("solo"), F.col("l_returnflag").alias("kind"), "term")
    return rows.groupBy("author", "term").agg(F.count("*").alias("n"), F.count_if("solo").alias("n_solo"), F.count_if(F.col("kind") == "R").alias("n_requests"))


@_R.add(f"""
SELECT o.o_orderkey, coalesce(l.n, 0) AS n_votes, coalesce(e.n, 0) AS n_present FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_tax > 0.04 GROUP BY 1) l ON l_orderkey = o_orderkey
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) e ON user_id = o_custkey""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session with how many were present and voted: two aggregates, joined."""
    votes = table(spark, sf_dir, "lineitem").filter("l_tax > 0.04").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("v"))
    present = table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("p"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(votes, "o_orderkey", "left").join(present, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("v", F.lit(0)).alias("n_votes"), F.coalesce("p", F.lit(0)).alias("n_present"))


@_R.add("""
SELECT lang, source, count(*) AS n, count(DISTINCT CASE WHEN quality IS NOT NULL THEN d.doc_id END) AS n_summarised, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_good, CAST(sum(n_chars) * 50 // count(*) AS BIGINT) AS mean_confidence, count(*) FILTER (WHERE n_chars < 500) AS n_low,
 count(*) FILTER (WHERE n_chars >= 500 AND n_chars < 2000) AS n_middle FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) GROUP BY lang, source""")
def summary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by summaries, mean (in millionths) and low confidence, and what waits for review in each band."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    n = F.col("n_chars")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("n_summarised"), F.count_if(F.col("quality") == 1).alias("n_good"),
        F.expr("CAST(sum(n_chars) AS BIGINT) * 50 DIV count(*)").alias("mean_confidence"), F.count_if(n < 500).alias("n_low"), F.count_if((n >= 500) & (n < 2000)).alias("n_middle"))
