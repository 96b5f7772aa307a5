"""Report, page and text extraction and what is detected in it. Texts are put together from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import clustering, extract
from ..sources.tables import table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
#: An amount of whole units and cents as reports write it.
_BR = "regexp_replace(format_number({0}, 2, 'en'), '', '')"


def _money(x: str):
    return F.translate(F.format_number(F.expr(x), 2), ",.", ".,")


@_R.add("""
SELECT lpad(CAST(o_orderkey AS VARCHAR), 5, '0') || '-001' AS number, CAST(year(o_orderdate) AS INT) AS fiscal_year, CAST(o_custkey AS VARCHAR) AS payee_code, 'Customer, ' || o_custkey AS payee_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS committed_on,
 CAST(CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS value FROM orders""")
def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry as three lines of a report: its row, a filler and a payment order under the same number."""
    o = table(spark, sf_dir, "orders")
    number = F.expr("lpad(CAST(o_orderkey AS STRING), 5, '0') || '-001 / ' || year(o_orderdate)")
    amount = _money("CAST(o_totalprice AS DECIMAL(18,2))")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    quoted = lambda *parts: F.concat(F.lit('"'), F.concat_ws('","', *parts), F.lit('",""'))
    dash = F.lit(" -")
    committed = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), amount)).otherwise(dash)
    paid = F.when(F.col("o_orderkey") % 3 == 1, amount).otherwise(dash)
    line = lambda n, kind: quoted(n, F.expr("o_custkey || ' - Customer, ' || o_custkey"), F.lit(kind), F.lit(""), F.lit("1"), day, day, F.lit(""), committed, dash, paid)
    lines = o.select(F.explode(F.array(line(number, "EO"), F.lit('"","","Historic, of before"'), line(number, "OP"))).alias("line"))
    out = extract.ledger_lines(lines, "line")
    return out.withColumns({"committed_on": F.col("committed_on").cast("string"), "value": F.col("value").cast("double")})


@_R.add("""
SELECT c_nationkey AS file, CAST(c_custkey AS VARCHAR) AS registration, c_mktsegment AS department, CAST(1 + c_custkey % 13 AS INT) AS month, CAST(2020 AS INT) AS year, CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS DOUBLE) AS gross, CAST(10 AS DOUBLE) AS net,
 CAST(1 + c_custkey % 3 AS BIGINT) AS n_rubrics, CAST(1.5 * (1 + c_custkey % 3) AS DOUBLE) AS earnings FROM customer WHERE c_custkey % 4 > 0""")
def payroll_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as blocks of a report for each nation; totals stand in a quoted cell of two lines, every fourth block has none."""
    c = table(spark, sf_dir, "customer")
    totals = F.concat(F.lit('TOTALS;"Gross: '), _money("CAST(abs(c_acctbal) AS DECIMAL(18,2))"))
    lines = F.concat(
        F.array(F.expr("'REGISTRATION;' || c_custkey"), F.expr("'DEPARTMENT;' || c_mktsegment"), F.expr("'PERIOD;' || (1 + c_custkey % 13) || '/2020'")),
        F.expr("transform(sequence(1, CAST(1 + c_custkey % 3 AS INT)), i -> i || ';Pay;1,50;0,00')"),
        F.when(F.col("c_custkey") % 4 > 0, F.array(totals, F.lit('Net: 10,00"'))).otherwise(F.array().cast("array<string>")),
    )
    rows = c.select(F.col("c_nationkey").alias("file"), "c_custkey", F.posexplode(lines).alias("at", "line"))
    return extract.payroll_blocks(rows.select("file", (F.col("c_custkey") * 100 + F.col("at")).alias("number"), "line"), "file", "number", "line")


@_R.add("SELECT p_partkey, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CASE p_partkey % 5 WHEN 0 THEN 'sheet' WHEN 1 THEN 'docx' WHEN 2 THEN 'rejected' WHEN 3 THEN 'text' ELSE 'pdf' END AS format FROM part")
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled values of a page, and how its file would be read."""
    html = F.expr("'<tr><td><b>Brand:</b>&nbsp;' || p_brand || '</td><td>Size:</td>\n<td class=\"x\">' || p_size || '</td></tr>'")
    name = F.expr("'a.pdf.' || CASE p_partkey % 5 WHEN 0 THEN 'XLSX' WHEN 1 THEN 'docx?x=1' WHEN 2 THEN 'zip' WHEN 3 THEN 'csv' ELSE 'bin' END")
    return table(spark, sf_dir, "part").select("p_partkey", extract.labelled(html, "Brand").alias("brand"), extract.labelled(html, "Size").alias("size"), extract.file_format(name).alias("format"))


@_R.add("""
SELECT l_orderkey, l_linenumber AS item_no, CAST(l_quantity AS DOUBLE) AS quantity, CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS VARCHAR) END AS supplier, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS total FROM lineitem""")
def json_items_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each process as one JSON page, each with an array of results that may be empty."""
    item = F.struct(F.col("l_linenumber").alias("item_no"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_returnflag") != "N", F.array(F.struct(F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_tax").alias("total")))).alias("results"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(item)).alias("page"))
    schema = "array<struct<item_no:int, quantity:double, results:array<struct<supplier:string, total:double>>>>"
    items = pages.select("l_orderkey", F.explode(F.from_json("page", schema)).alias("i"))
    return items.select("l_orderkey", "i.item_no", "i.quantity", F.explode_outer("i.results").alias("r")).select("l_orderkey", "item_no", "quantity", "r.supplier", "r.total")


@_R.add("""
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'b' || event_id ELSE NULL END AS track, event_id % 3 = 2 AS automatic, 'partner ' || user_id AS partner, 'video ' || event_id AS title, substr(event_type, 1, 3) AS channel FROM events""")
def json_xml_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption track of a language, the first partner of a company, and an entry of a feed."""
    e = table(spark, sf_dir, "events")
    tracks = F.expr("""CASE WHEN event_id % 3 > 0 THEN '{"tracks":[{"lang":"en","id":"a"},{"lang":"pt","id":"b' || event_id || '","kind":"' || CASE WHEN event_id % 3 = 2 THEN 'asr' ELSE '' END || '"},{"lang":"pt","id":"c"}],"partners":[{"name":"partner ' || user_id || '"}]}'
        ELSE '{"tracks":[],"partners":[{"name":"partner ' || user_id || '"}]}' END""")
    feed = F.expr("'<feed><entry><title>video ' || event_id || '</title><media ch=\"' || substr(event_type, 1, 3) || '\"/></entry></feed>'")
    j = F.from_json(tracks, "tracks array<struct<lang:string, id:string, kind:string>>, partners array<struct<name:string>>")
    rows = e.select("event_id", j.alias("j"), feed.alias("x")).withColumn("t", F.get(F.filter("j.tracks", lambda t: t["lang"] == "pt"), 0))
    return rows.select("event_id", F.col("t.id").alias("track"), F.coalesce(F.col("t.kind") == "asr", F.lit(False)).alias("automatic"), F.get("j.partners", 0)["name"].alias("partner"),
        F.xpath_string("x", F.lit("feed/entry/title")).alias("title"), F.xpath_string("x", F.lit("feed/entry/media/@ch")).alias("channel"))


@_R.add("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'Firm ' || o_custkey || ' Ltd' END AS winner, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS value, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
 lpad(CAST(o_custkey AS VARCHAR), 14, '3') || '-1-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 6, '0') || '/2021' AS control,
 round(least(0.95, 0.45 + 0.13 * (2 + CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE 1 END + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END)), 2) AS confidence FROM orders""")
def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Winner: Firm ' || o_custkey || ' Ltd; ' WHEN 1 THEN 'Awarded to Firm ' || o_custkey || ' Ltd for works. ' ELSE '' END")
    value = F.concat(F.lit("Total value of R$ "), _money("CAST(o_totalprice AS DECIMAL(18,2))"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN ' per unit. ' ELSE '. ' END"))
    control = F.expr("' Control ' || lpad(CAST(o_custkey AS STRING), 14, '3') || '-1-' || lpad(CAST(o_orderkey % 1000 AS STRING), 6, '0') || '/2021.'")
    t = F.concat(said, value, F.lit("Homologated on "), F.date_format("o_orderdate", "dd/MM/yyyy"), control)
    return extract.award(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")), "o_orderkey", "t")


@_R.add("""
SELECT p_partkey, CAST(unnest([1, 3]) AS INT) AS item, p_name AS description, p_size AS quantity, 'CX' AS unit, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part""")
def text_item_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda n: F.concat(F.lit(f"{n}. "), F.col("p_name"), F.lit(" - "), F.col("p_size").cast("string"), F.lit(" CX - R$ "), _money("CAST(p_retailprice AS DECIMAL(18,2))"))
    t = F.concat_ws("\n", F.lit("List of items"), line(1), F.lit("2. without a price"), line(3), F.lit("End"))
    return extract.item_table(table(spark, sf_dir, "part").select("p_partkey", t.alias("t")), "p_partkey", "t")


@_R.add("""
SELECT s_suppkey, CAST(1 AS INT) AS item, 'B' AS supplier, CAST(2 AS DOUBLE) AS value, 'negotiated' AS layout, 0.92 AS confidence FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
SELECT s_suppkey, 1, 'A', 1000.5, 'ranked', 0.88 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT s_suppkey, 2, 'C ' || s_suppkey, 3, 'declared', 0.86 FROM supplier""")
def item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("'Item 1 1st place A: R$ 1.000,50\\nItem 2 result C ' || s_suppkey || ': R$ 3,00\\nItem 1 result D: R$ 9,00' || CASE WHEN s_suppkey % 2 = 0 THEN '\\nItem 1 negotiated with B: R$ 2,00' ELSE '' END")
    return extract.item_results(table(spark, sf_dir, "supplier").select("s_suppkey", t.alias("t")), "s_suppkey", "t")


@_R.add("SELECT c_custkey, c_name AS author, 'works in ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'and more' ELSE '' END AS object, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS sphere FROM customer")
def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields behind labels, as far as the next one, over lines."""
    t = F.expr("'Author: ' || c_name || ' Object: works in ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '\\nand more' ELSE '' END || CASE WHEN c_custkey % 3 > 0 THEN '\\nSphere: ' || c_nationkey ELSE '' END")
    return extract.labelled_fields(table(spark, sf_dir, "customer").select("c_custkey", t.alias("t")), "c_custkey", "t", ["Author", "Object", "Sphere"])


@_R.add("""
SELECT source, count(*) AS n, CAST(sum(CAST(credit AS DECIMAL(18,2))) AS DOUBLE) AS credit, count(DISTINCT number) AS n_decrees, min(day_phrase) AS day_phrase, min(authority) AS authority FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'excess revenue' WHEN 1 THEN 'annulment' ELSE 'unreadable' END AS source,
 CAST(o_totalprice AS DECIMAL(18,2)) AS credit, o_custkey AS number, '5 of may of 2020' AS day_phrase, 'Mayor' AS authority FROM orders) GROUP BY source""")
def decree_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits that decrees open, by the source they name."""
    source = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'from excess revenue' WHEN 1 THEN 'from annulment' ELSE 'fr0m exc' END")
    t = F.concat(F.expr("'DECREE No ' || o_custkey || ', of 5 of may of 2020. The Mayor of X opens an additional credit of R$ '"), _money("CAST(o_totalprice AS DECIMAL(18,2))"), F.lit(" "), source)
    rows = table(spark, sf_dir, "orders").select(*extract.decree(t))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("credit").cast("decimal(18,2)")).cast("double").alias("credit"), F.countDistinct("number").alias("n_decrees"), F.min("day_phrase").alias("day_phrase"), F.min("authority").alias("authority"))


_LAWS = "(SELECT DISTINCT doc_id, n, y FROM (SELECT doc_id, unnest([doc_id % 50, doc_id % 7]) AS n, unnest([2000 + doc_id % 20, 2001]) AS y FROM documents))"


@_R.add(f"SELECT number, year, n_citing FROM (SELECT CAST(n AS INT) AS number, CAST(y AS INT) AS year, count(*) AS n_citing FROM {_LAWS} GROUP BY ALL) WHERE NOT (number % 2 = 0 AND year < 2010)")
def missing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws cited by documents that the corpus does not have, with how many cite them; years out of bounds are no citations."""
    t = F.expr("text || ' see Law no ' || (doc_id % 50) || '/' || (2000 + doc_id % 20) || ', LAW ' || (doc_id % 7) || '/2001 and law 12/1789.'")
    cited = extract.cited_laws(table(spark, sf_dir, "documents").select("doc_id", t.alias("t")), "doc_id", "t", (1900, 2100))
    counts = cited.groupBy("number", "year").agg(F.count("*").alias("n_citing"))
    have = spark.range(0, 50, 2).select(F.col("id").cast("int").alias("number"), F.explode(F.sequence(F.lit(2000), F.lit(2009))).alias("year"))
    return counts.join(have, ["number", "year"], "left_anti")


@_R.add("""
WITH f AS (SELECT doc_id, 'works' AS topic, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 END AS q, CAST(2000 + doc_id % 5 AS INT) AS year FROM documents UNION ALL SELECT doc_id, 'fleet', CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 END, CAST(2000 + doc_id % 5 AS INT) FROM documents WHERE doc_id % 2 = 0)
SELECT topic, year, count(*) AS n_facts, CAST(coalesce(sum(q), 0) AS BIGINT) AS quantity, count(DISTINCT doc_id) AS n_documents, CASE WHEN sum(q) >= 90 THEN 'critical' ELSE 'high' END AS severity FROM f GROUP BY topic, year HAVING coalesce(sum(q), 0) >= 60 AND count(DISTINCT doc_id) >= 3""")
def fact_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of topics by year: enough of them in enough documents."""
    t = F.expr("'obra' || CASE WHEN doc_id % 2 = 0 THEN ' e frota' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ': ' || (doc_id % 90) || ' units' ELSE '' END")
    docs = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    found = extract.facts(docs, "doc_id", "t", {"works": "obra", "fleet": "frota"}, "([0-9]+) units").withColumn("year", (2000 + F.col("doc_id") % 5).cast("int"))
    out = found.groupBy("topic", "year").agg(F.count("*").alias("n_facts"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"), F.countDistinct("doc_id").alias("n_documents"))
    return out.filter("quantity >= 60 AND n_documents >= 3").withColumn("severity", F.when(F.col("quantity") >= 90, "critical").otherwise("high"))


@_R.add("""
SELECT event, year, count(*) AS n_documents, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 4) || 'a feira do livro' WHEN 1 THEN 'carnaval de rua' END AS event, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS v FROM orders) WHERE event IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def event_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that several documents of a year are about."""
    t = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Contratação: ' || (o_custkey % 4) || 'ª Feira do Livro' WHEN 1 THEN 'Show no Carnaval de Rua' ELSE 'Obra' END")
    t = F.regexp_replace(t, "ª", "a")
    rows = table(spark, sf_dir, "orders").select(extract.event_name(t).alias("event"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return rows.filter("event IS NOT NULL").groupBy("event", "year").agg(F.count("*").alias("n_documents"), F.sum("v").cast("double").alias("total")).filter("n_documents >= 2")


@_R.add(f"SELECT unit AS category, fiscal_year AS year, count(DISTINCT payee_id) AS n_documents FROM {LEDGER} GROUP BY ALL HAVING count(DISTINCT payee_id) >= 2")
def thematic_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import ledger

    rows = ledger(spark, sf_dir).groupBy(F.col("unit").alias("category"), F.col("fiscal_year").alias("year")).agg(F.countDistinct("payee_id").alias("n_documents"))
    return rows.filter("n_documents >= 2")


@_R.add("""
SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_high, CASE event_id % 4 WHEN 0 THEN 'q1|q2|q3|q4|q5' WHEN 3 THEN '' ELSE 'q1|q2' END AS questions FROM events""")
def summary_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a high level and at most five questions out of summaries; a summary that is no JSON has none."""
    j = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"alerts":[{"level":"high"},{"level":"low"},{"level":"high"}],"gaps":["q1","q2","q3"],"items":["q2","q4","q5","q6"]}'
      WHEN 1 THEN '{"alerts":[{"level":"high"}],"gaps":["q1"],"items":["q2"]}' WHEN 2 THEN '{"alerts":[],"gaps":["q1","q2"]}' ELSE '{broken' END""")
    p = F.from_json(j, "alerts array<struct<level:string>>, gaps array<string>, items array<string>")
    rows = table(spark, sf_dir, "events").select("event_id", p.alias("p"))
    none = F.array().cast("array<string>")
    asked = F.slice(F.array_distinct(F.concat(F.coalesce("p.gaps", none), F.coalesce("p.items", none))), 1, 5)
    return rows.select("event_id", F.coalesce(F.size(F.filter("p.alerts", lambda a: a["level"] == "high")), F.lit(0)).cast("bigint").alias("n_high"), F.array_join(asked, "|").alias("questions"))


_PENDING = """CASE WHEN event_id % 5 = 0 THEN ['no-evidence'] ELSE [] END || CASE WHEN event_id % 7 = 0 AND event_id % 5 > 0 THEN ['no-source'] ELSE [] END || CASE WHEN event_id % 11 = 0 THEN ['placeholder'] ELSE [] END || CASE WHEN event_id % 13 = 0 THEN ['accusation'] ELSE [] END"""


@_R.add(f"""
SELECT advice, code, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 OR event_id % 13 = 0 THEN 'block' WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 'check' ELSE 'ok' END AS advice, unnest(CASE WHEN len(c) = 0 THEN ['none'] ELSE c END) AS code FROM (SELECT event_id, {_PENDING} AS c FROM events)) GROUP BY ALL""")
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is pending with each finding, and what that means for its publication."""
    from ..operators.detect import revalidated

    text_ = F.expr("'Finding ' || CASE WHEN event_id % 11 = 0 THEN '____' ELSE 'x' END || CASE WHEN event_id % 13 = 0 THEN ' a fraud' ELSE '' END")
    urls = F.expr("CASE WHEN event_id % 5 = 0 THEN array() WHEN event_id % 7 = 0 THEN array('http://a', NULL) ELSE array('http://a') END")
    rows = revalidated(table(spark, sf_dir, "events").select("event_id", text_.alias("text"), urls.alias("urls")), "text", "urls")
    each = rows.select("advice", F.explode(F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("none")))).alias("code"))
    return each.groupBy("advice", "code").agg(F.count("*").alias("n"))


# Findings in words that both engines take: addresses of each piece of evidence, parted by spaces, pieces by |.
_FINDING = """event_id, substr(props, 1, 0) || 'Achado ' || event_type || CASE event_id % 11 WHEN 0 THEN ' de ____' WHEN 1 THEN ' de XXXX' WHEN 2 THEN ' .....' WHEN 3 THEN ' sem nada' ELSE ' ok' END || CASE WHEN event_id % 13 = 0 THEN ': Fraude' WHEN event_id % 13 = 1 THEN ': crime' ELSE '' END AS text,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://a x|HTTPS://b' WHEN 2 THEN 'ftp://a|http://b' WHEN 3 THEN 'a|b c' ELSE 'https://c' END AS addresses,
 CASE WHEN event_id % 17 = 0 THEN 'ai-risk' END AS origin, CASE WHEN event_id % 19 = 0 THEN 'legacy other' WHEN event_id % 19 = 1 THEN 'other' END AS why, CASE event_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' END AS state,
 CASE event_id % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' END AS factual, CASE WHEN event_id % 2 = 0 THEN 'factual' END AS kind, event_id % 7 > 2 AS investigated, CASE event_id % 23 WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' END AS gate,
 CASE WHEN value > 5 THEN value END AS value, CASE WHEN event_id % 29 > 0 THEN '2024' END AS period"""


@_R.add(f"""
WITH f AS (SELECT {_FINDING} FROM events), e AS (SELECT *, CASE WHEN addresses IS NULL THEN [] ELSE list_transform(string_split(addresses, '|'), lambda p: len(list_filter(string_split(p, ' '), lambda u: regexp_matches(lower(u), '^https?://')))) END AS good FROM f),
p AS (SELECT event_id, list_filter([
 CASE WHEN len(good) = 0 THEN 'block no-evidence' WHEN list_max(good) = 0 THEN 'block no-source' WHEN list_min(good) = 0 THEN 'attention no-source' END,
 CASE WHEN regexp_matches(text, '___|XXXX|[.][.][.][.][.]') THEN 'block placeholder' END, CASE WHEN regexp_matches(lower(text), 'fraud|crim') THEN 'block accusation' END, CASE WHEN origin = 'ai-risk' THEN 'attention ai-only-risk' END,
 CASE WHEN list_contains(string_split(why, ' '), 'legacy') THEN 'attention legacy' END, CASE WHEN state = 'published' AND factual IS DISTINCT FROM 'passed' THEN 'attention published-without-gate' WHEN kind = 'factual' AND NOT investigated THEN 'info not-investigated' END,
 CASE WHEN gate = 'failed' THEN 'attention gate-failed' END, CASE WHEN value IS NOT NULL AND period IS NULL THEN 'attention value-without-period' END], lambda c: c IS NOT NULL) AS c FROM e),
a AS (SELECT CASE WHEN len(list_filter(c, lambda x: starts_with(x, 'block'))) > 0 THEN 'block' WHEN len(list_filter(c, lambda x: starts_with(x, 'attention'))) > 0 THEN 'check' ELSE 'ok' END AS advice, c FROM p)
SELECT advice, code, count(*) AS n FROM (SELECT advice, unnest(CASE WHEN len(c) = 0 THEN ['none'] ELSE c END) AS code FROM a) GROUP BY ALL""")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that can be pending with findings, with its gravity, and the advice that follows."""
    from ..operators.detect import pending_codes

    rows = spark.sql(f"SELECT {_FINDING} FROM {{events}}", events=table(spark, sf_dir, "events"))
    rows = rows.withColumns({"urls": F.transform(F.split("addresses", "[|]"), lambda p: F.split(p, " ")), "reasons": F.split("why", " ")})
    got = pending_codes(rows)
    none = F.array(F.lit("none"))
    said = F.transform("pending", lambda p: F.concat_ws(" ", p["gravity"], p["code"]))
    return got.select("advice", F.explode(F.when(F.size("pending") > 0, said).otherwise(none)).alias("code")).groupBy("advice", "code").agg(F.count("*").alias("n"))


@_R.add("SELECT event_id, event_id % 2 = 1 OR (event_id % 3 > 0 AND event_id % 10 > 0) AS may_publish FROM events")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of deterministic versions need every field ticked and nothing pending."""
    from ..operators.detect import may_publish

    ticked = F.expr("CASE WHEN event_id % 3 > 0 THEN array('value', 'source', 'period') ELSE array('value') END")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "deterministic-2").otherwise("ai-1").alias("version"), ticked.alias("ticked"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(0).alias("pending"))
    return rows.select("event_id", may_publish(F.col("version"), F.col("ticked"), ["value", "source", "period"], F.col("pending")).alias("may_publish"))


@_R.add()
def greedy_jaccard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in order of id: a text joins the first centre whose words are alike to 0.75."""
    return clustering.greedy_jaccard_clusters(table(spark, sf_dir, "documents"), "source", "doc_id", text.tokens(F.col("text")), 0.75)


@_R.add()
def recurring_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that recur with a source: clusters of two documents or more."""
    return greedy_jaccard_clusters(spark, sf_dir).groupBy("source", "centre").agg(F.count("*").alias("n_documents")).filter("n_documents >= 2")
