"""Classes of titles, labels and messages, shapes of texts, votes on projects and dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
# Texts in words that both engines take.
_TITLE = "CASE k % 6 WHEN 0 THEN CAST(k % 40 AS VARCHAR(9)) || 'ª Sessão Ordinária' WHEN 1 THEN ' ' || CAST(k % 9 AS VARCHAR(9)) || ' sessao EXTRAORDINÁRIA de maio' WHEN 2 THEN 'Audiência  Pública' WHEN 3 THEN 'Sessão Ordinária' WHEN 4 THEN 'Reunião ' || t ELSE '3º Sessão Solene' END"
_LABEL = "CASE k % 7 WHEN 0 THEN 'Lei  Ordinária' WHEN 1 THEN 'DECRETO' WHEN 2 THEN 'Projeto de Resolução' WHEN 3 THEN 'Emenda à Lei Orgânica' WHEN 4 THEN 'Promulgada' WHEN 5 THEN NULL ELSE ' Ata de Comissão' END"
_ERROR = "CASE k % 13 WHEN 0 THEN '' WHEN 1 THEN 'limite de 9 caracteres' WHEN 2 THEN 'Fonte mudou' WHEN 3 THEN 'HTTP 410' WHEN 4 THEN 'model ' || t || ' not found' WHEN 5 THEN 'Timed out' WHEN 6 THEN 'Too Many Requests' WHEN 7 THEN '[{\"code\": 1, \"path\": 2}]' WHEN 8 THEN 'ZodError' WHEN 9 THEN 'PNCP HTTP 403' WHEN 10 THEN 'HTTP 401' WHEN 11 THEN 'ECONNRESET' ELSE 'HTTP 50' || CAST(k % 10 AS VARCHAR(9)) END"
_EVENTS = "(SELECT event_id AS k, event_type AS t FROM events)"


@_R.add(f"""
WITH x AS (SELECT k, {_TITLE} AS title, {_LABEL} AS label, {_ERROR} AS error FROM {_EVENTS}), n AS (SELECT *, lower(strip_accents(title)) AS ft, trim(regexp_replace(lower(strip_accents(coalesce(label, ''))), '\\s+', ' ', 'g')) AS fl, lower(error) AS fe FROM x)
SELECT k, CASE WHEN regexp_matches(ft, '^ *[0-9]+ *[aº°ª]? *sessao +extra') THEN 'sessao_extraordinaria' WHEN regexp_matches(ft, '^ *[0-9]+ *[aº°ª]? *sessao +ordinaria') THEN 'sessao_ordinaria' WHEN regexp_matches(ft, 'audiencia +publica') THEN 'audiencia_publica' ELSE 'outro' END AS video,
 TRY_CAST(CASE WHEN regexp_matches(ft, '^ *[0-9]+ *[aº°ª]? *sessao +(extra)?ordinaria') THEN regexp_extract(ft, '([0-9]+)', 1) END AS INT) AS number,
 CASE fl WHEN 'lei ordinaria' THEN 'lei_ordinaria' WHEN 'decreto' THEN 'decreto' WHEN 'projeto de resolucao' THEN 'projeto_resolucao' WHEN 'emenda a lei organica' THEN 'emenda_lei_organica' WHEN 'ata de comissao' THEN 'ata_comissao' ELSE 'documento_publico' END AS act,
 CASE WHEN error = '' THEN 'sem_erro' WHEN contains(fe, 'limite de') THEN 'limite_tamanho' WHEN contains(fe, 'fonte mudou') THEN 'revisao_fonte' WHEN contains(fe, '410') OR regexp_matches(fe, 'model.*not found') THEN 'modelo_indisponivel' WHEN contains(fe, 'timed out') THEN 'timeout' WHEN contains(fe, 'too many') THEN 'limite_provider'
  WHEN starts_with(fe, '[{{') THEN 'contrato_rejeitado' WHEN contains(fe, 'zod') THEN 'contrato_invalido' WHEN contains(fe, 'pncp') THEN 'fonte_bloqueada' WHEN contains(fe, '401') THEN 'credencial' WHEN contains(fe, 'econn') THEN 'rede' ELSE 'outro' END AS error_class,
 contains(fe, 'timed out') OR contains(fe, 'econnreset') OR regexp_matches(fe, 'http 5[0-9][0-9]') AS transient FROM n""")
def classes_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by title, legal acts by label, errors by message."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("event_type").alias("t")).selectExpr("k", f"{_TITLE} AS title", f"{_LABEL} AS label", f"{_ERROR} AS error")
    v = classify.video(F.col("title"))
    return rows.select("k", v["kind"].alias("video"), v["number"].alias("number"), classify.act_type(F.col("label")).alias("act"), classify.error_class(F.col("error")).alias("error_class"), classify.is_transient(F.col("error")).alias("transient"))


_SAID = lambda words: " + ".join(f"CAST(contains(f, '{w}') AS INT)" for w in words)


@_R.add(f"""
WITH x AS (SELECT doc_id, text, source, lower(strip_accents(text)) AS f, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda l: trim(l)), lambda l: l <> '') AS l, regexp_extract_all(text, '[A-Za-zÀ-ÿ0-9]+') AS r FROM documents),
s AS (SELECT doc_id, source, len(l) AS n_lines, len(list_filter(l, lambda z: regexp_matches(z, '[.!?;:]$') AND len(list_filter(string_split_regex(z, '\\s+'), lambda w: regexp_matches(w, '[A-Za-zÀ-ÿ]{{3,}}'))) >= 8)) AS n_sentences,
 CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda z: length(z))) / len(l) ELSE 0.0 END AS mean_line, CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda z: length(z) <= 3)) / len(r) ELSE 0.0 END AS short_tokens,
 len(regexp_extract_all(text, '\\b[0-9]{{1,4}}[,.][0-9]{{2,4}}\\b')) AS n_coordinates, {_SAID(classify.DRAWING_WORDS)} AS n_drawing, {_SAID(classify.PROSE_WORDS)} AS n_prose FROM x)
SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(n_sentences AS INT) AS n_sentences, round(mean_line, 6) AS mean_line, round(short_tokens, 6) AS short_tokens, CAST(n_coordinates AS INT) AS n_coordinates,
 CAST(CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN n_drawing >= 4 THEN 3 WHEN n_drawing >= 2 THEN 1 ELSE 0 END + CASE WHEN short_tokens >= 0.42 THEN 2 ELSE 0 END + CASE WHEN n_coordinates >= 20 THEN 2 ELSE 0 END + CASE WHEN n_lines >= 20 AND mean_line < 45 THEN 1 ELSE 0 END
 + CASE WHEN n_lines >= 20 AND n_sentences / n_lines < 0.08 THEN 1 ELSE 0 END - CASE WHEN doc_id % 7 = 0 THEN 6 ELSE 0 END - CASE WHEN n_prose >= 1 THEN 3 ELSE 0 END AS INT) AS score FROM s""")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lengths, sentences, short tokens and coordinates of all documents, and how much speaks for a drawing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(classify.text_shape(F.col("text")))).alias("s"))
    score = classify.drawing_score(F.col("s"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0)
    return rows.select("doc_id", "s.n_lines", "s.n_sentences", F.round("s.mean_line", 6).alias("mean_line"), F.round("s.short_tokens", 6).alias("short_tokens"), "s.n_coordinates", score.alias("score"))


@_R.add("""
WITH j AS (SELECT event_id, props AS a, CASE event_id % 4 WHEN 0 THEN '{"z": null, "k": ' || json_extract_string(props, '$.k') || ', "l": [1, {"b": 1, "a": 2}]}' WHEN 1 THEN '[2, 1]' WHEN 2 THEN 'no json' ELSE props END AS one,
 CASE event_id % 8 WHEN 0 THEN '{"l": [1, {"a": 2, "b": 1}], "k": ' || json_extract_string(props, '$.k') || ', "z": null}' WHEN 4 THEN '{"l": [{"a": 2, "b": 1}, 1], "k": ' || json_extract_string(props, '$.k') || ', "z": null}' WHEN 1 THEN '[1, 2]' WHEN 5 THEN '[2,1]' WHEN 2 THEN 'no json' WHEN 6 THEN 'other' WHEN 3 THEN '{"k": "' || json_extract_string(props, '$.k') || '"}' ELSE '  ' || props END AS two FROM events)
SELECT event_id, event_id % 8 IN (1, 3, 4, 6) AS changed, one = two AS same_text FROM j""")
def json_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of JSON texts that differ by nothing, by the order of keys, of lists, by type, or as texts."""
    k = "get_json_object(props, '$.k')"
    one = F.expr(f"""CASE event_id % 4 WHEN 0 THEN '{{"z": null, "k": ' || {k} || ', "l": [1, {{"b": 1, "a": 2}}]}}' WHEN 1 THEN '[2, 1]' WHEN 2 THEN 'no json' ELSE props END""")
    two = F.expr(f"""CASE event_id % 8 WHEN 0 THEN '{{"l": [1, {{"a": 2, "b": 1}}], "k": ' || {k} || ', "z": null}}' WHEN 4 THEN '{{"l": [{{"a": 2, "b": 1}}, 1], "k": ' || {k} || ', "z": null}}' WHEN 1 THEN '[1, 2]' WHEN 5 THEN '[2,1]' WHEN 2 THEN 'no json' WHEN 6 THEN 'other' WHEN 3 THEN '{{"k": "' || {k} || '"}}' ELSE '  ' || props END""")
    return table(spark, sf_dir, "events").select("event_id", classify.json_changed(one, two).alias("changed"), (one == two).alias("same_text"))


_MATTER = "CASE k % 4 WHEN 0 THEN 'Projeto de Lei nº 0' || CAST(k % 30 AS VARCHAR(9)) WHEN 1 THEN 'Projeto de Lei Complementar n. ' || CAST(k % 30 AS VARCHAR(9)) || ' e Projeto de Resolução nº ' || CAST(k % 11 AS VARCHAR(9)) WHEN 2 THEN 'Emenda à Lei Orgânica nº ' || CAST(k % 30 AS VARCHAR(9)) ELSE 'Moção' END"
_HELD = "CASE k % 3 WHEN 0 THEN 'aprovado o projeto número ' || CAST(k % 30 AS VARCHAR(9)) ELSE 'votou-se o n. ' || CAST(k % 11 AS VARCHAR(9)) || ' e o nº 00' || CAST(k % 30 AS VARCHAR(9)) END"
_KIND = "CASE k % 4 WHEN 0 THEN 'projeto_lei' WHEN 1 THEN 'projeto_lei_complementar' WHEN 2 THEN 'projeto_resolucao' ELSE 'projeto_emenda_lei_organica' END"


@_R.add(f"""
WITH v AS (SELECT k, y AS vote_year, ' ' || trim(regexp_replace(lower(strip_accents({_MATTER})), '[^a-z0-9]+', ' ', 'g')) || ' ' AS m, ' ' || trim(regexp_replace(lower(strip_accents({_HELD})), '[^a-z0-9]+', ' ', 'g')) || ' ' AS h FROM (SELECT o_orderkey AS k, year(o_orderdate) AS y FROM orders WHERE o_orderstatus = 'P')),
p AS (SELECT k AS project, CASE {_KIND} WHEN 'projeto_lei' THEN 'projeto de lei' WHEN 'projeto_lei_complementar' THEN 'projeto de lei complementar' WHEN 'projeto_resolucao' THEN 'projeto de resolucao' ELSE 'emenda a lei organica' END AS label, k % 30 AS number, CAST(1995 + k % 6 AS BIGINT) AS year FROM (SELECT p_partkey AS k FROM part)),
j AS (SELECT label, number, year, k FROM (SELECT DISTINCT label, number, year FROM p) p JOIN v ON contains(regexp_replace(m, ' n 0+([0-9])', ' n \\1', 'g'), ' ' || label || ' n ' || number || ' ') AND regexp_matches(h, ' (n|numero) 0*' || number || ' ')
  AND vote_year >= year AND floor((vote_year - 2025) / 4.0) = floor((year - 2025) / 4.0))
SELECT project, count(DISTINCT k) AS n_votes, min(k) AS first_vote FROM p JOIN j USING (label, number, year) GROUP BY project""")
def votes_on_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that name a project's kind and number in their matter and excerpt, within its term."""
    votes = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.year("o_orderdate").alias("year"))
    votes = votes.selectExpr("k AS vote", f"{_MATTER} AS matter", f"{_HELD} AS excerpt", "year")
    projects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).selectExpr("k AS project", f"{_KIND} AS kind", "k % 30 AS number", "CAST(1995 + k % 6 AS INT) AS year")
    return classify.project_vote_counts(projects, votes)


@_R.add(f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY payee_id ORDER BY value DESC, entry_id) AS a FROM {LEDGER}), d AS (SELECT *, row_number() OVER (PARTITION BY payee_id, a <= 3 ORDER BY entry_date DESC, entry_id) AS b FROM v)
SELECT payee_id, entry_id, CASE WHEN a <= 3 THEN 'value' ELSE 'recent' END AS part FROM d WHERE a <= 3 OR b <= 3""")
def payee_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six entries of each payee's dossier: three by value, three of the rest by recency."""
    return classify.dossier_sample(ledger(spark, sf_dir), "payee_id", "value", "entry_date", "entry_id", 6).select("payee_id", "entry_id", "part")


@_R.add(f"""
WITH s AS (SELECT payee_id, unit, count(*) AS n, sum(value) AS v, min(entry_date) AS a, max(entry_date) AS b FROM {LEDGER} GROUP BY ALL)
SELECT payee_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS total, CAST(min(a) AS VARCHAR) AS first_day, CAST(max(b) AS VARCHAR) AS last_day, count(*) AS n_units, first(unit ORDER BY v DESC, unit DESC) AS top_unit, round(CAST(max(v) AS DOUBLE) / CAST(sum(v) AS DOUBLE), 6) AS top_share FROM s GROUP BY payee_id""")
def payee_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, span, units and the share of the greatest unit of each payee."""
    got = classify.dossier_totals(ledger(spark, sf_dir), "payee_id", "value", "entry_date", "unit")
    return got.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@_R.add("""
WITH x AS (SELECT *, coalesce(CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_shipdate AS DATE) END, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_shipdate AS DATE) + 5 END) AS day, l_partkey * 10 + l_linenumber AS key FROM lineitem)
SELECT l_orderkey AS document, key, CAST(day AS VARCHAR) AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY day IS NOT NULL DESC, day DESC, key DESC) AS k FROM x) WHERE k = 1""")
def latest_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each order with the last of its known dates."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS document", "l_partkey * 10 + l_linenumber AS key", "CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_shipdate AS DATE) END AS published", "CASE WHEN l_partkey % 2 = 0 THEN date_add(CAST(l_shipdate AS DATE), 5) END AS opened")
    best = classify.latest(rows, ["document"], ["published", "opened"], "key")
    return best.select("document", "key", F.coalesce("published", "opened").cast("string").alias("day"))


@_R.add("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), q AS (SELECT doc_id, l, list_transform(l, lambda z: list_filter(string_split_regex(z, '[ \\t]+'), lambda w: w <> '')) AS p FROM l),
g AS (SELECT doc_id, l, list_position(list_transform(p, lambda w: len(w) > 0 AND (len(list_filter(w, lambda z: regexp_matches(strip_accents(z), '^[A-Za-z]{3,}[.,;:]?$') OR regexp_matches(z, '^[0-9][0-9.,/-]*$'))) >= 3
 OR 10 * len(list_filter(w, lambda z: regexp_matches(strip_accents(z), '^[A-Za-z]{3,}[.,;:]?$') OR regexp_matches(z, '^[0-9][0-9.,/-]*$'))) >= 4 * len(w))), true) AS k FROM q)
SELECT doc_id, nullif(substr(trim(regexp_replace(array_to_string(CASE WHEN k > 0 THEN l[k:] ELSE l END, ' '), '\\s+', ' ', 'g')), 1, 280), '') AS snippet FROM g""")
def clean_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 280 characters of each document from its first line with content."""
    return table(spark, sf_dir, "documents").select("doc_id", classify.clean_snippet(F.col("text")).alias("snippet"))
