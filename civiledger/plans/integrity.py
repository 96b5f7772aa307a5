"""Audits, merges of duplicates and of parts, and minutes held against their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, merging, minutes
from ..sources.tables import table
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


def _checked(name: str, code: str, bad: str, key: str, source: str) -> str:
    return f"SELECT '{name}' AS \"table\", '{code}' AS code, count(*) AS n_rows, count(*) FILTER (WHERE {bad}) AS n_bad, CAST(min({key}) FILTER (WHERE {bad}) AS VARCHAR) AS first_key, CAST(max({key}) FILTER (WHERE {bad}) AS VARCHAR) AS last_key FROM {source}"


@_R.add(" UNION ALL ".join([
    _checked("documents", "no-text", "text IS NULL OR trim(text) = ''", "doc_id", "documents"), _checked("documents", "length-differs", "n_chars <> length(text)", "doc_id", "documents"),
    _checked("documents", "placeholder", "regexp_matches(text, '_{3,}|X{4,}|[.]{5,}')", "doc_id", "documents"),
    _checked("labels", "document-lost", "d.doc_id IS NULL", "l.doc_id", "labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 10 > 0) d ON l.doc_id = d.doc_id"),
    _checked("lineitem", "order-lost", "o_orderkey IS NULL", "l_orderkey", "lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey"),
    _checked("lineitem", "discount-range", "l_discount > 0.08 OR l_discount < 0", "l_orderkey", "lineitem"),
    "SELECT 'documents', 'same-text', CAST(sum(n) AS BIGINT), CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT), CAST(min(a) FILTER (WHERE n > 1) AS VARCHAR), CAST(max(b) FILTER (WHERE n > 1) AS VARCHAR) FROM (SELECT count(*) AS n, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY md5(text), lang)",
]))
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty and odd documents, repeated texts, labels and lines whose document or order is not among those kept."""
    documents = table(spark, sf_dir, "documents").withColumn("md5", F.md5("text"))
    return audits.audit({
        "documents": audits.Audited(documents, "doc_id", {"no-text": "text IS NULL OR trim(text) = ''", "length-differs": "n_chars <> length(text)", "placeholder": "text RLIKE '_{3,}|X{4,}|[.]{5,}'"}, unique={"same-text": ["md5", "lang"]}),
        "labels": audits.Audited(table(spark, sf_dir, "labels"), "doc_id", links={"document-lost": ("doc_id", "kept", "doc_id")}),
        "lineitem": audits.Audited(table(spark, sf_dir, "lineitem"), "l_orderkey", {"discount-range": "l_discount > 0.08 OR l_discount < 0"}, {"order-lost": ("l_orderkey", "open", "o_orderkey")}),
        "kept": audits.Audited(documents.filter("doc_id % 10 > 0"), "doc_id"),
        "open": audits.Audited(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey"),
    })


@_R.add("""
WITH RECURSIVE pairs AS (SELECT s_suppkey AS a, s_suppkey + CASE s_suppkey % 4 WHEN 0 THEN 1 ELSE 9 END AS b FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND s_suppkey % 5 > 0),
there AS (SELECT a, b FROM pairs WHERE b IN (SELECT s_suppkey FROM supplier)), links AS (SELECT a, b FROM there UNION SELECT b, a FROM there),
reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a), roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
best AS (SELECT root, first(s_suppkey ORDER BY s_acctbal DESC, s_suppkey) AS survivor FROM roots JOIN supplier ON s_suppkey = id GROUP BY root),
moved AS (SELECT id AS loser, survivor FROM roots JOIN best USING (root) WHERE id <> survivor),
lines AS (SELECT coalesce(survivor, l_suppkey) AS supplier, l_partkey, l_quantity, l_suppkey, survivor IS NULL AS own, l_orderkey, l_linenumber FROM lineitem LEFT JOIN moved ON l_suppkey = loser),
kept AS (SELECT supplier, l_quantity FROM lines WHERE supplier NOT IN (SELECT survivor FROM moved) UNION ALL SELECT supplier, l_quantity FROM
  (SELECT *, row_number() OVER (PARTITION BY supplier, l_partkey ORDER BY own DESC, l_orderkey, l_linenumber) AS k FROM lines WHERE supplier IN (SELECT survivor FROM moved)) WHERE k = 1),
sums AS (SELECT supplier, count(*) AS n_lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM kept GROUP BY supplier), lost AS (SELECT survivor, count(*) AS n FROM moved GROUP BY survivor)
SELECT s_suppkey AS supplier, coalesce(n_lines, 0) AS n_lines, quantity, coalesce(n, 0) AS n_losers FROM supplier LEFT JOIN sums ON s_suppkey = supplier LEFT JOIN lost ON s_suppkey = survivor WHERE s_suppkey NOT IN (SELECT loser FROM moved)""")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers said to be the same, in chains, merged into the one with the highest balance, and their lines with them, each part once."""
    suppliers = table(spark, sf_dir, "supplier")
    pairs = suppliers.filter("s_suppkey % 4 IN (0, 1) AND s_suppkey % 5 > 0").selectExpr("s_suppkey AS a", "s_suppkey + CASE s_suppkey % 4 WHEN 0 THEN 1 ELSE 9 END AS b")
    lines = merging.Child(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity"), "l_suppkey", ["l_partkey"], ["l_orderkey", "l_linenumber"])
    out = merging.merge_duplicates(suppliers, "s_suppkey", pairs, [-F.col("s_acctbal")], {"lines": lines}, ["s_name"])
    sums = out["lines"].groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("double").alias("quantity"))
    losers = out["merged"].groupBy(F.col("survivor").alias("supplier")).agg(F.count("*").alias("n_losers"))
    rows = out["records"].select(F.col("s_suppkey").alias("supplier")).join(sums, "supplier", "left").join(losers, "supplier", "left")
    return rows.select("supplier", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "quantity", F.coalesce("n_losers", F.lit(0)).alias("n_losers"))


_PARTS = """(SELECT l_orderkey AS document, l_suppkey % 2 AS source, CASE WHEN l_quantity > 3 THEN l_linenumber % 4 END AS number, CASE WHEN l_quantity > 30 THEN 'x' END AS unit, l_partkey % 3 AS content, l_discount AS confidence, l_linenumber AS nth FROM lineitem)"""


@_R.add(f"""
WITH p AS (SELECT *, coalesce(CAST(number AS VARCHAR), 'none') || '/' || source || '/' || CASE WHEN number IS NULL THEN coalesce(unit, '-') || content ELSE '' END AS identity FROM {_PARTS}),
i AS (SELECT document, CASE WHEN number IS NULL THEN coalesce(unit, '-') || content ELSE identity END AS identity, count(DISTINCT coalesce(unit, '-') || content) AS n, min(confidence) AS c FROM p GROUP BY ALL),
spans AS (SELECT document, source, (nth - 1) * 10 AS a, nth * 10 + CASE WHEN content = 0 THEN 5 ELSE 0 END AS b FROM p),
points AS (SELECT document, source, a, b, coalesce(max(b) OVER (PARTITION BY document, source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM spans),
reads AS (SELECT document, source, bool_and(a <= before) AS whole, max(b) AS upto FROM points GROUP BY ALL), sources AS (SELECT document, source, 20 AS length FROM p GROUP BY ALL),
cover AS (SELECT document, bool_and(whole AND upto >= length) AS complete FROM sources JOIN reads USING (document, source) GROUP BY document),
r AS (SELECT document, count(*) AS n_rows, count(*) FILTER (WHERE n > 1) AS n_contradictions, min(c) AS confidence FROM i GROUP BY document)
SELECT document, n_rows, n_contradictions, confidence, CASE WHEN n_contradictions > 0 THEN 'contradictory' WHEN NOT complete THEN 'incomplete' ELSE 'merged' END AS verdict FROM r JOIN cover USING (document)""")
def merged_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of what was extracted from each order, merged in two groupings that overlap, with contradictions and gaps."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document", "l_suppkey % 2 AS source", "CASE WHEN l_quantity > 3 THEN l_linenumber % 4 END AS number", "CASE WHEN l_quantity > 30 THEN 'x' END AS unit", "l_partkey % 3 AS content", "l_discount AS confidence", "l_linenumber AS nth")
    state = lambda part: merging.part_state(part, "document", ["source"], "number", ["unit", "content"], "confidence")
    merged = merging.merged_state(merging.merged_state(state(rows.filter("nth <= 2")), state(rows.filter("nth > 4"))), merging.merged_state(state(rows.filter("nth > 1")), state(rows.filter("nth <= 3"))))
    spans = rows.selectExpr("document", "source", "(nth - 1) * 10 AS start", "nth * 10 + CASE WHEN content = 0 THEN 5 ELSE 0 END AS end")
    sources = rows.select("document", "source").distinct().withColumn("length", F.lit(20))
    return merging.merge_result(merged, merging.covered(spans, sources))


# Minutes in words that both engines take: three names, how they vote and a tally.
_NAMES = ("CASE k % 3 WHEN 0 THEN 'Ana Paula Souza' WHEN 1 THEN 'Paula Lima' ELSE 'João Ribeiro' END", "CASE k % 4 WHEN 0 THEN 'Edir Costa' WHEN 1 THEN 'Júlio Cezar Dias' ELSE 'Rita Alves' END")
_MINUTES = """'Ata da sessão de ' || CASE k % 5 WHEN 0 THEN '3 de maio de 2020' ELSE '10 3 2021' END || '. Presentes os vereadores ' || a || ' e ' || b || CASE WHEN k % 2 = 0 THEN '. Deu-se início aos trabalhos. ' ELSE '. Aberta a sessão, falou ' END || 'Carlos Melo. O projeto foi votado: votaram a favor ' || a || CASE WHEN k % 6 < 3 THEN ' e contra ' ELSE ' e ' END || b || CASE WHEN k % 7 = 0 THEN ', com abstenção de Carlos Melo' ELSE '' END || '. Nada mais.'"""
_EXCERPT = "'votaram a favor ' || a || CASE WHEN k % 6 < 3 THEN ' e contra ' ELSE ' e ' END || CASE WHEN k % 11 = 0 THEN 'outro' ELSE b END"


@_R.add(f"""
WITH w0 AS (SELECT o_orderkey AS k FROM orders), w1 AS (SELECT k, {_NAMES[0]} AS a, {_NAMES[1]} AS b FROM w0), w AS (SELECT *, {_MINUTES} AS t, {_EXCERPT} AS e FROM w1),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(strip_accents(t)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS nt, ' ' || trim(regexp_replace(lower(strip_accents(e)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS ne, lower(strip_accents(a)) AS na, lower(strip_accents(b)) AS nb FROM w),
o AS (SELECT *, substr(nt, 1, list_min(list_filter([strpos(nt, ' deu se inicio '), strpos(nt, ' aberta a sessao ')], lambda i: i > 1))) AS first FROM n),
p AS (SELECT *, [x for x in [[na, a], [nb, b], ['carlos melo', 'Carlos Melo']] if contains(first, ' ' || x[1] || ' ')] AS present, contains(nt, trim(ne)) AS held,
  list_filter(range(1, length(ne)), lambda i: regexp_matches(ne[i:], '^ (a favor|contra|abstencao) ')) AS marks FROM o),
v AS (SELECT *, strpos(ne, ' ' || nb || ' ') AS pb, ne[list_max(list_filter(marks, lambda i: i < strpos(ne, ' ' || nb || ' '))):] AS before_b FROM p),
x AS (SELECT *, CASE WHEN starts_with(before_b, ' a favor') THEN 'favoravel' WHEN starts_with(before_b, ' contra') THEN 'contrario' END AS vote_b FROM v),
y AS (SELECT *, held AND len([z for z in present if z[1] = na]) > 0 AS a_good, held AND pb > 0 AND vote_b = 'contrario' AS b_good, CASE WHEN k % 5 = 0 THEN contains(first, ' maio ') ELSE contains(first, ' marco ') OR contains(first, ' 10 3 2021 ') END AS day_good FROM x)
SELECT k, CASE WHEN day_good THEN CASE WHEN k % 5 = 0 THEN '2020-05-03' ELSE '2021-03-10' END END AS day, len(present) AS n_present,
 CASE WHEN held THEN CASE WHEN k % 13 = 0 AND a_good THEN '' ELSE array_to_string([CASE WHEN a_good THEN a || ' favoravel' END, CASE WHEN b_good THEN b || ' contrario' END], ', ') END END AS named,
 CAST(1 + CASE WHEN NOT held THEN 1 ELSE 0 END + CASE WHEN held AND pb = 0 THEN 1 ELSE 0 END + CASE WHEN held AND pb > 0 AND NOT b_good THEN 1 ELSE 0 END + CASE WHEN held AND k % 13 = 0 AND a_good THEN 1 ELSE 0 END AS INT) AS warnings FROM y""")
def checked_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and what is said to be in them: who was there, and named votes that their nearest word of voting bears out."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).selectExpr("k", f"{_NAMES[0]} AS a", f"{_NAMES[1]} AS b").selectExpr("*", f"{_MINUTES} AS text", f"{_EXCERPT} AS excerpt")
    named = F.expr("array(named_struct('name', a, 'vote', 'favoravel'), named_struct('name', 'Vereador ' || b, 'vote', 'contrario'))")
    vote = F.struct(F.lit("projeto").alias("matter"), F.col("excerpt"), named.alias("named"), F.expr("CASE WHEN k % 13 = 0 THEN 0 END").alias("favour"), F.lit(None).cast("int").alias("against"), F.lit(None).cast("int").alias("abstained"))
    said = F.struct(F.col("a").alias("president"), F.expr("array(a, b, 'Carlos Melo')").alias("present"), F.array().cast("array<string>").alias("absent"), F.expr("CASE WHEN k % 5 = 0 THEN DATE '2020-05-03' ELSE DATE '2021-03-10' END").alias("day"), F.array(vote).alias("votes"))
    got = minutes.validated(rows.withColumn("said", said), "k", "text", "said", F.lit("2024-01-01").cast("date"))
    listed = F.array_join(F.transform(F.col("votes")[0]["named"], lambda n: F.concat_ws(" ", n["name"], n["vote"])), ", ")
    return got.select("k", F.col("day").cast("string").alias("day"), F.size("present").cast("bigint").alias("n_present"), F.when(F.size("votes") > 0, listed).alias("named"), "warnings")
