"""Text functions, classifiers and extraction over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import rules
from ..sources import files
from ..sources.tables import table
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_FOLD = "lower(strip_accents({0}))"


@_R.add("""
SELECT doc_id, sha256(lower(strip_accents(text))) AS folded, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
 CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_estimate FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(text.fold_lower(t), 256).alias("folded"), F.length(text.digits(t)).cast("bigint").alias("n_digits"), text.token_estimate(t).alias("token_estimate")
    )


@_R.add("""
WITH s AS (SELECT *, regexp_replace(regexp_replace(lower(strip_accents(p_name || ' (' || p_brand || ')')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part)
SELECT p_partkey, slug, 'pf-' || slug AS payee_key, substr(sha256(CAST(p_partkey AS VARCHAR) || '|' || slug), 1, 16) AS stable_id FROM s""")
def slug_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", text.slug(name).alias("slug"), text.payee_key(F.lit(None).cast("string"), name).alias("payee_key"), text.stable_key(F.col("p_partkey").cast("string"), text.slug(name)).alias("stable_id"))


@_R.add(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[email]', 'g'),
 '\d{3}\.\d{3}\.\d{3}-\d{2}', '[cpf]', 'g'), '(?i)cpf[: ]*\d{11}', '[cpf]', 'g'), '\+?\d{0,3} ?\(\d{2,3}\) ?\d{3,5}-\d{4}', '[phone]', 'g')) AS masked FROM documents""")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.mask(F.col("text")), 256).alias("masked"))


@_R.add(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT doc_id, list_filter(string_split_regex(line, '[ \t]+'), lambda w: length(w) > 0) AS w FROM l),
r AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(strip_accents(x), '^[A-Za-z]{3,}[.,;:]?$') OR regexp_matches(x, '^[0-9][0-9.,/-]*$'))) AS good FROM p)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE n > 0 AND (good >= 3 OR good * 10 >= n * 4)) AS n_good FROM r GROUP BY doc_id""")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), F.size(F.filter(lines, text.line_quality)).cast("bigint").alias("n_good"))


@_R.add("""
WITH s AS (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 100) / 700.0), 1) AS BIGINT))) AS i FROM documents),
c AS (SELECT doc_id, i, trim(substr(text, i * 700 + 1, 800)) AS piece FROM s)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(length(piece)) AS BIGINT) AS chars, md5(string_agg(piece, '|' ORDER BY i)) AS digest FROM c WHERE length(piece) > 0 GROUP BY doc_id""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.chunks(F.col("text"), 800, 100).alias("c")).filter(F.size("c") > 0)
    chars = F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return rows.select("doc_id", F.size("c").cast("bigint").alias("n_chunks"), chars.alias("chars"), F.md5(F.array_join("c", "|")).alias("digest"))


GROUPS = {"travel": [(3, "tion"), (2, "ing")], "works": [(4, "ment"), (1, "que")], "health": [(2, "cion"), (2, "ado")]}


@_R.add(f"""
WITH t AS (SELECT doc_id, {_FOLD.format("text")} AS t FROM documents), s AS (SELECT doc_id, 3 * CAST(regexp_matches(t, 'tion') AS INT) + 2 * CAST(regexp_matches(t, 'ing') AS INT) AS a,
 4 * CAST(regexp_matches(t, 'ment') AS INT) + CAST(regexp_matches(t, 'que') AS INT) AS b, 2 * CAST(regexp_matches(t, 'cion') AS INT) + 2 * CAST(regexp_matches(t, 'ado') AS INT) AS c FROM t)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a = greatest(a, b, c) THEN 'travel' WHEN b = greatest(a, b, c) THEN 'works' ELSE 'health' END AS category,
 CASE WHEN greatest(a, b, c) = 0 THEN 0.0 WHEN a = greatest(a, b, c) THEN round(a / 5.0, 4) WHEN b = greatest(a, b, c) THEN round(b / 5.0, 4) ELSE round(c / 4.0, 4) END AS confidence FROM s""")
def keyword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, confidence = rules.weighted_category(F.col("t"), GROUPS)
    rows = table(spark, sf_dir, "documents").select("doc_id", text.fold_lower(F.col("text")).alias("t"))
    return rows.select("doc_id", name.alias("category"), confidence.alias("confidence"))


ORDERED = [("copper", "copper"), ("steel", "steel"), ("small", "small|tiny"), ("ring", "ring$")]


@_R.add("""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'copper') THEN 'copper' WHEN regexp_matches(p_name, 'steel') THEN 'steel' WHEN regexp_matches(p_name, 'small|tiny') THEN 'small' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' ELSE 'other' END AS purpose,
 concat_ws(',', CASE WHEN regexp_matches(p_name, 'copper') THEN 'copper' END, CASE WHEN regexp_matches(p_name, 'ring$') THEN 'ring' END, CASE WHEN regexp_matches(p_name, 'small|tiny') THEN 'small' END, CASE WHEN regexp_matches(p_name, 'steel') THEN 'steel' END) AS markers FROM part""")
def ordered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_rule(name, ORDERED, "other").alias("purpose"), F.array_join(rules.markers(name, ORDERED), ",").alias("markers"))


#: Literal citations appended to the documents, which hold none of their own.
_CITED = "text || ' Processo 12/2021, empenho ' || doc_id || '/2023; total R$ 1.' || lpad(CAST(doc_id % 1000 AS {0}), 3, '0') || ',50.'"


@_R.add(f"""
WITH t AS (SELECT doc_id, {_CITED.format("VARCHAR")} AS t FROM documents), r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '\\b([0-9]{{1,6}}/(?:19|20)[0-9]{{2}})\\b', 1)) AS reference FROM t)
SELECT doc_id, reference, lpad(ltrim(split_part(reference, '/', 1), '0'), 6, '0') || '/' || split_part(reference, '/', 2) AS padded FROM r""")
def regex_extract_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CITED.format("STRING")).alias("t"))
    return rules.cited_references(docs, "doc_id", "t")


@_R.add(f"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all({_CITED.format("VARCHAR")}, 'R\\$ ?([0-9]{{1,3}}(?:\\.[0-9]{{3}})*,[0-9]{{2}})', 1)) AS a FROM documents)
SELECT doc_id, CAST(len(a) AS INT) AS n_amounts, CASE WHEN len(a) = 1 THEN CAST(CAST(replace(replace(a[1], '.', ''), ',', '.') AS DECIMAL(18,2)) AS DOUBLE) END AS amount FROM t""")
def single_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CITED.format("STRING")).alias("t"))
    return rules.single_amount(docs, "doc_id", "t")


@_R.add("SELECT page_id, k AS position, link FROM (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS k FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages))")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.links(F.col("html"))).alias("k", "link"))
    return rows.select("page_id", F.col("k").cast("bigint").alias("position"), "link")


@_R.add(r"""
SELECT page_id, CAST(len(l) AS BIGINT) AS n_items, md5(array_to_string(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \n\t]+', ' ', 'g'))), '|')) AS digest
FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)""")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = files.list_items(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(items).cast("bigint").alias("n_items"), F.md5(F.array_join(items, "|")).alias("digest"))


@_R.add("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@_R.add("""
SELECT o_orderkey, CASE WHEN v = 0 THEN 'ok' WHEN v < 100 THEN 'low' WHEN v > 100000000 THEN 'high' ELSE 'ok' END AS plausible, floor(v / 3 * 100 + 0.5) / 100 AS third FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)""")
def money_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", money.plausibility(v).alias("plausible"), money.half_up(v / 3, 2).alias("third"))


@_R.add("SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.length("text")).alias("chars"))
