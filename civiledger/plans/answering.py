"""Searches with filters, phrases and sections, and the evaluation of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import fold_lower
from ..operators import evaluate, search
from ..sources.tables import table
from .indexes import kept_index
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_WORDS = "list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')"
_PREFIXES = ["the", "ing", "eres"]


@_R.add(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM w), i AS (SELECT doc_id, term, any_value(l) AS l, count(*) AS tf FROM t GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN starts_with(term, 'the') THEN 0 WHEN starts_with(term, 'ing') THEN 1 WHEN starts_with(term, 'eres') THEN 2 END AS k FROM i), r AS (SELECT * FROM p WHERE k IS NOT NULL), d AS (SELECT term, count(*) AS df FROM r GROUP BY 1),
n AS (SELECT count(*) AS n, avg(l) AS a FROM (SELECT doc_id, len(w) AS l FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM r JOIN d USING (term), n GROUP BY doc_id HAVING count(DISTINCT k) = 3)
SELECT doc_id, score, count(*) OVER () AS n_all FROM s JOIN documents USING (doc_id) WHERE lang = 'en' AND n_chars > 1000 ORDER BY score DESC, doc_id LIMIT 20""")
def ranked_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best English documents of some length for three prefixes, and how many there are."""
    where = (F.col("lang") == "en") & (F.col("n_chars") > 1000)
    docs = table(spark, sf_dir, "documents").filter(where).select(F.col("doc_id").alias("doc"))
    good = kept_index(spark, sf_dir).prefix_and(_PREFIXES).join(docs, "doc", "left_semi")
    total = good.agg(F.count("*").alias("n_all"))
    best = good.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return best.join(F.broadcast(total), F.lit(True))  # one row


_ANY = f"(SELECT doc_id, CAST(list_contains(w, 'heer') AS INT) + CAST(list_contains(w, 'lichkeit') AS INT) AS n_terms, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS has_phrase FROM (SELECT doc_id, {_WORDS} AS w FROM documents))"


@_R.add(f"SELECT doc_id, n_terms, has_phrase FROM {_ANY} WHERE n_terms > 0 OR has_phrase")
def any_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.any_terms(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), ["heer", "lichkeit"], [["of", "the"]])


@_R.add(f"""
SELECT doc_id, row_number() OVER (ORDER BY CAST(has_phrase AS INT) DESC, CASE WHEN has_phrase THEN n_terms ELSE 0 END DESC, place) AS place FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM {_ANY} WHERE n_terms > 0 OR has_phrase ORDER BY doc_id LIMIT 50)""")
def identifier_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = any_term_search(spark, sf_dir).orderBy("doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))  # 50 candidates
    return search.promoted(top, "doc_id", F.col("has_phrase"), F.col("n_terms"), "rank").withColumn("place", F.col("place").cast("bigint"))


@_R.add("""
SELECT 'documents' AS section, CAST(doc_id AS VARCHAR) AS key FROM (SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'one') ORDER BY doc_id LIMIT 5) UNION ALL
SELECT 'parts', CAST(p_partkey AS VARCHAR) FROM (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'one') ORDER BY p_partkey LIMIT 5) UNION ALL
SELECT 'suppliers', CAST(s_suppkey AS VARCHAR) FROM (SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '1') ORDER BY s_suppkey LIMIT 5)""")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hits of each section."""
    sections = (("documents", "documents", "doc_id", "text", "one"), ("parts", "part", "p_partkey", "p_name", "one"), ("suppliers", "supplier", "s_suppkey", "s_name", "1"))
    out = None
    for name, source, key, text, q in sections:
        rows = table(spark, sf_dir, source).filter(fold_lower(F.col(text)).contains(q)).orderBy(key).limit(5).select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_R.add("""
SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 200 AND 3000 AND (contains(lower(strip_accents(text)), 'ereson') OR contains(lower(source), 'src1'))""")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured filters, and words in the text or, where the text has none, the source."""
    terms = keys.search_terms("Ereson")
    hit = fold_lower(F.col("text")).contains(terms[0]) | fold_lower(F.col("source")).contains("src1")
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & F.col("n_chars").between(200, 3000) & hit).select("doc_id", "source")


@_R.add("""
WITH context AS (SELECT doc_id % 50 AS query, doc_id AS doc, text, source AS url FROM documents),
cited AS (SELECT doc_id % 50 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS query, doc_id AS doc, CASE doc_id % 3 WHEN 0 THEN substr(text, 5, 26) WHEN 1 THEN substr(text, 5, 20) || '#~' ELSE substr(text, 5, 3) END AS quote,
  CASE WHEN doc_id % 7 = 0 THEN source || '/x' ELSE source END AS url FROM documents)
SELECT c.query IN (SELECT query FROM context) AND x.doc IS NOT NULL AS in_context, coalesce(length(quote) >= 10 AND contains(x.text, quote) AND c.url IS NOT DISTINCT FROM x.url, false) AS valid, count(*) AS n
FROM cited c LEFT JOIN context x ON c.query = x.query AND c.doc = x.doc GROUP BY ALL""")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of all documents, each from the context of one of 50 questions: some too short, altered, of another address or of another question's context."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    context = docs.select((F.col("doc_id") % 50).alias("query"), F.col("doc_id").alias("doc"), "text", F.col("source").alias("url"))
    quote = F.expr("CASE doc_id % 3 WHEN 0 THEN substring(text, 5, 26) WHEN 1 THEN substring(text, 5, 20) || '#~' ELSE substring(text, 5, 3) END")
    cited = docs.select(F.expr("doc_id % 50 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END").alias("query"), F.col("doc_id").alias("doc"), quote.alias("quote"), F.expr("CASE WHEN doc_id % 7 = 0 THEN source || '/x' ELSE source END").alias("url"))
    known = context.select("query", "doc", F.lit(True).alias("in_context"))
    rows = evaluate.valid_citations(cited, context).join(known, ["query", "doc"], "left")
    return rows.groupBy(F.coalesce("in_context", F.lit(False)).alias("in_context"), "valid").agg(F.count("*").alias("n"))


@_R.add("""
SELECT event_id, CAST(event_id % 3 AS INT) AS n_invented, CASE WHEN event_id % 5 = 0 THEN 'fraud' ELSE '' END AS accusing, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 1.0 ELSE 0.5 END AS coverage, event_id % 4 <> 1 AS refusal_right FROM events""")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that no source has, accusing words, facts said and whether refusing was right."""
    said = F.expr("CASE event_id % 3 WHEN 0 THEN array('1,00') WHEN 1 THEN array('1,00', '2,00') ELSE array('3,00', '2,00') END")
    answer = F.expr("'The ring of ' || event_id || CASE WHEN event_id % 5 = 0 THEN ' is a Fraud' ELSE '' END")
    facts = F.expr("CASE event_id % 4 WHEN 0 THEN array() WHEN 1 THEN array('RING') ELSE array('ring', 'never said') END")
    refused, should = F.col("event_id") % 4 < 2, F.col("event_id") % 4 < 1
    rows = table(spark, sf_dir, "events").select("event_id", F.size(evaluate.invented(said, F.array(F.lit("1,00")))).alias("n_invented"), F.array_join(evaluate.accusing(answer), ",").alias("accusing"),
        evaluate.fact_coverage(answer, facts.cast("array<string>")).alias("coverage"), (refused == should).alias("refusal_right"))
    return rows


_REPORT = "(SELECT 'long' AS metric, CASE WHEN count(*) > 0 THEN avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0 END) END AS value FROM {0} UNION ALL SELECT 'short', CASE WHEN count(*) > 0 THEN avg(CASE WHEN n_chars < 100 THEN 1.0 ELSE 0 END) END FROM {0} UNION ALL SELECT 'lang ' || lang, count(*) / 1000.0 FROM {0} GROUP BY lang)"


@_R.add(f"""
WITH late AS (SELECT * FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr'), early AS (SELECT * FROM documents WHERE doc_id % 2 = 0 AND lang <> 'es'), now AS {_REPORT.format('late')}, before AS {_REPORT.format('early')},
least AS (SELECT * FROM (VALUES ('long', 0.05), ('short', 0.9), ('lang fr', 0.001)) t(metric, least)),
gain AS (SELECT coalesce(n.metric, b.metric) AS metric, n.value AS a, b.value AS b, (n.value - b.value) * CASE WHEN coalesce(n.metric, b.metric) = 'short' THEN -1 ELSE 1 END AS g FROM now n FULL JOIN before b ON n.metric = b.metric)
SELECT 'gate' AS what, metric, CASE WHEN coalesce(value >= least, false) THEN 'true' ELSE 'false' END AS verdict FROM least LEFT JOIN now USING (metric) UNION ALL
SELECT 'report', metric, CASE WHEN a IS NULL THEN 'worse' WHEN b IS NULL THEN 'better' WHEN g > 0.01 THEN 'better' WHEN g < -0.01 THEN 'worse' ELSE 'equal' END FROM gain""")
def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of one half of the documents held against thresholds, where a missing one fails, and against the other half's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")

    def figures(rows: DataFrame) -> DataFrame:
        share = rows.agg(F.avg((F.col("n_chars") > 1000).cast("double")).alias("long"), F.avg((F.col("n_chars") < 100).cast("double")).alias("short"))
        long = share.unpivot([], ["long", "short"], "metric", "value")
        return long.unionByName(rows.groupBy(F.concat(F.lit("lang "), "lang").alias("metric")).agg((F.count("*") / 1000).alias("value")))

    now, before = figures(docs.filter("doc_id % 2 = 1 AND lang <> 'fr'")), figures(docs.filter("doc_id % 2 = 0 AND lang <> 'es'"))
    gate = evaluate.gate(now, {"long": 0.05, "short": 0.9, "lang fr": 0.001}).select(F.lit("gate").alias("what"), "metric", F.col("passed").cast("string").alias("verdict"))
    return gate.unionByName(evaluate.compared_reports(now, before, ("short",), 0.01).select(F.lit("report").alias("what"), "metric", "verdict"))
