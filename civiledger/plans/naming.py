"""Keys, names, guards, value chains and dates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, money, suppliers, text
from ..operators import quality, search
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_KIND_SQL = "CASE WHEN {c} LIKE '%pregao eletronico%' THEN 'pregao-eletronico' WHEN {c} LIKE '%pregao%' THEN 'pregao' WHEN {c} LIKE '%tomada de preco%' THEN 'tomada-de-precos' WHEN {c} LIKE '%convite%' THEN 'convite' END"
#: Names of procurements by order, with and without accents.
_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'PREGÃO ELETRÔNICO' WHEN 1 THEN 'Tomada de Preços' WHEN 2 THEN 'Convite' ELSE 'Outro' END"
_KIND_BY_KEY = "CASE o_orderkey % 4 WHEN 0 THEN 'pregao-eletronico' WHEN 1 THEN 'tomada-de-precos' WHEN 2 THEN 'convite' END"
_CODE = _NAME + " || ' - ' || lpad(CAST(o_orderkey % 10000 AS {0}), 4, '0') || CAST(year(o_orderdate) + 15 AS {0})"


@_R.add(f"""
SELECT o_orderkey, CASE WHEN y BETWEEN 2010 AND 2050 THEN {_KIND_BY_KEY} END AS type, CASE WHEN y BETWEEN 2010 AND 2050 THEN CAST(o_orderkey % 10000 AS INT) END AS number,
 CASE WHEN y BETWEEN 2010 AND 2050 THEN CAST(y AS INT) END AS year FROM (SELECT *, year(o_orderdate) + 15 AS y FROM orders)""")
def modality_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", keys.modality_code(F.expr(_CODE.format("STRING"))).alias("m"))
    return rows.select("o_orderkey", "m.type", "m.number", "m.year")


_TITLE = "'Processo ' || CAST(o_orderkey AS {0}) || '/2020 - ' || " + _NAME + " || ' - ' || CAST(o_custkey AS {0}) || '/' || CAST(year(o_orderdate) AS {0})"


@_R.add(f"""
SELECT o_orderkey, {_KIND_BY_KEY} AS type, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS INT) END AS number, CASE WHEN o_orderkey % 4 < 3 THEN CAST(year(o_orderdate) AS INT) END AS year FROM orders""")
def modality_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", keys.modality_title(F.expr(_TITLE.format("STRING"))).alias("m"))
    return rows.select("o_orderkey", "m.type", "m.number", "m.year")


@_R.add(f"SELECT o_orderkey, o_orderkey % 4 < 3 AND o_orderkey % 10000 = o_custkey AND o_orderkey % 3 = 0 AS exact FROM orders")
def exact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and titles of the same order, whose years agree in a third of the cases."""
    code = keys.modality_code(F.expr(_NAME + " || ' - ' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') || CAST(2020 + o_orderkey % 3 AS STRING)"))
    title = keys.modality_title(F.expr(_NAME + " || ' - ' || CAST(o_custkey AS STRING) || '/2020'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("c"), title.alias("t")).select("o_orderkey", keys.exact_link(F.col("c"), F.col("t")).alias("exact"))


@_R.add("""
SELECT o_orderkey, CASE WHEN length(k) >= 4 THEN k ELSE t END AS process, CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 14, '1') || '-1-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 6, '0') || '/2021' END AS control,
 CASE WHEN o_orderkey % 3 > 0 THEN 'N' || o_orderkey END AS number
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'sem numero' ELSE CAST(o_orderkey % 100 AS VARCHAR) || '/2021' END AS t, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 100 AS VARCHAR) || '2021' END AS k FROM orders)""")
def process_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    process = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN ' Sem Número ' ELSE CAST(o_orderkey % 100 AS STRING) || '/21' END")
    control = F.expr("lpad(CAST(o_custkey AS STRING), 14, '1') || '-1-' || CAST(o_orderkey % 1000 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '/2021' ELSE '/21' END")
    number = F.expr("CASE WHEN o_orderkey % 3 > 0 THEN ' (N' || o_orderkey || ').' ELSE ' -- ' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", keys.process_key(process).alias("process"), keys.control_number(control).alias("control"), keys.document_number(number).alias("number"))


@_R.add("""
SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, upper(s_name) AS supplier, CASE WHEN s_suppkey % 2 = 0 THEN 'tax' ELSE 'name' END AS key_kind,
 CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 14, '2') END AS tax_id, CASE WHEN s_suppkey % 2 = 1 THEN lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) END AS slug,
 CASE WHEN s_suppkey % 2 = 0 THEN regexp_replace(lpad(CAST(s_suppkey AS VARCHAR), 14, '2'), '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5') END AS formatted FROM supplier""")
def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("' ' || s_suppkey || ' -  ' || s_name || ' '").alias("raw"), F.expr("'Empresa: ' || s_name || ', inscrita no CNPJ 1'").alias("said"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS STRING), 14, '2') END").alias("tax"), "s_name")
    code, name = keys.payee_parts(F.col("raw"))
    rows = rows.select("s_suppkey", code.alias("code"), name.alias("name"), keys.supplier_name(F.col("said")).alias("supplier"), text.payee_key(F.col("tax"), F.col("s_name")).alias("k"), keys.formatted_tax_id(F.col("tax")).alias("formatted"))
    kind, tax, slug = keys.payee_key_parts(F.col("k"))
    return rows.select("s_suppkey", "code", "name", "supplier", kind.alias("key_kind"), tax.alias("tax_id"), slug.alias("slug"), "formatted")


@_R.add("""
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) || '-jr' WHEN 1 THEN lower(n_name) || '-jr-silva' ELSE lower(n_name) END AS slug, CAST(2 AS INT) AS n_authors,
 n_nationkey % 2 = 1 AS garbage, CASE WHEN n_nationkey % 2 = 0 THEN 'https://x.example/entry/2020/' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') || '-001' ELSE 'https://x.example/search' END AS link
FROM (SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g') AS n_name FROM nation)""")
def person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("n_name || CASE n_nationkey % 3 WHEN 0 THEN ' Júnior' WHEN 1 THEN ' Junior Silva' ELSE '' END")
    unit = F.expr("CASE WHEN n_nationkey % 2 = 1 THEN '12.' ELSE 'CX' END")
    number = F.expr("lpad(CAST(n_nationkey AS STRING), 5, '0') || CASE WHEN n_nationkey % 2 = 0 THEN '-001' ELSE '' END")
    return table(spark, sf_dir, "nation").select("n_nationkey", keys.person_slug(name).alias("slug"), F.size(keys.authors(F.concat(name, F.lit(" ,  , Ana   Lima")))).alias("n_authors"),
        keys.is_garbage_unit(unit).alias("garbage"), keys.deep_link(F.lit(2020), number, "https://x.example").alias("link"))


@_R.add("""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice END AS total, CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 1000 END AS lot, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 1000 END AS whole, l_extendedprice / l_quantity AS unit, l_quantity AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN total > 0 THEN total WHEN lot > 0 THEN lot WHEN whole > 0 THEN whole ELSE unit * q END, 4) AS best, CASE WHEN total > 0 THEN 'total' WHEN lot > 0 THEN 'lot' WHEN whole > 0 THEN 'whole' ELSE 'product' END AS best_from,
 CASE WHEN whole > 0 THEN 'whole' WHEN lot > 0 THEN 'lot' WHEN total > 0 THEN 'total' ELSE 'product' END AS checked_from FROM v""")
def value_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both value chains over line items that state some of the values."""
    v = [F.expr(e) for e in ("CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice END", "CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 1000 END", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 1000 END", "l_extendedprice / l_quantity", "l_quantity")]
    best, of = keys.best_value(*v)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(best, 4).alias("best"), of.alias("best_from"), keys.checked_value(*v)[1].alias("checked_from"))


@_R.add("""
SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN 'paid' WHEN l_linestatus = 'F' THEN 'settled' ELSE 'committed' END AS state, CASE WHEN l_extendedprice > 90000 THEN 'ceiling' WHEN l_extendedprice / (o_totalprice / 3) > 1.05 THEN 'above-process' ELSE 'ok' END AS plausible,
 CASE WHEN l_linenumber = 1 THEN 'lot' WHEN l_linenumber = 2 THEN 'whole' WHEN l_quantity = 1 THEN 'unit' ELSE 'total' END AS kind, count(*) AS n,
 count(CASE WHEN l_linestatus = 'F' THEN o_custkey END) AS n_linked, CAST(sum(CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS guarded
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def payment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, plausibility of items against their process, kind of value, link and value hidden where a condition fails."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    settled, paid = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    name = F.expr("CASE l_linenumber WHEN 1 THEN 'Lote 1' WHEN 2 THEN 'Valor Global' ELSE 'Item' END")
    rows = rows.select("l_returnflag", keys.payment_state(settled, paid).alias("state"), keys.item_plausibility(F.col("l_extendedprice"), F.col("o_totalprice") / 3, 90_000).alias("plausible"),
        keys.value_kind(name, F.col("l_quantity")).alias("kind"), F.when(F.col("l_linestatus") == "F", F.col("o_custkey")).alias("link"), F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"))
    return rows.groupBy("l_returnflag", "state", "plausible", "kind").agg(F.count("*").alias("n"), F.count("link").alias("n_linked"), F.sum("value").cast("double").alias("guarded"))


@_R.add("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(d AS VARCHAR) END AS day, CASE WHEN o_orderkey % 4 > 0 AND d <= DATE '1998-06-30' THEN CAST(d AS VARCHAR) END AS not_future,
 o_orderkey % 4 > 0 AND d >= DATE '1998-06-01' AND d <= DATE '1998-06-30' AS recent, o_orderkey % 4 > 0 AND year(d) <> 1996 AS diverges, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2001 WHEN o_orderkey % 4 > 0 THEN year(d) ELSE 1990 END AS INT) AS reference_year,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN year(d) >= 1998 THEN 'daily' WHEN year(d) = 1997 THEN 'weekly' ELSE 'monthly' END AS cadence FROM d""")
def date_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three spellings (one of them no date), against a fixed present day."""
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '31/02/1997' WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(raw).alias("d"))
    today, d = F.to_date(F.lit("1998-06-30")), F.col("d")
    return rows.select("o_orderkey", d.cast("string").alias("day"), dates.not_future(d, today).cast("string").alias("not_future"), dates.is_recent(d, today, 30).alias("recent"),
        dates.diverges(d, F.lit(1996)).alias("diverges"), F.coalesce(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 2001 END"), F.year(d), F.lit(1990)).alias("reference_year"), dates.cadence(F.year(d), F.year(today)).alias("cadence"))


@_R.add("SELECT event_id, CAST(ts - INTERVAL 3 HOUR AS DATE)::VARCHAR AS local_day, CAST(hour(ts - INTERVAL 3 HOUR) AS INT) AS local_hour FROM events")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.from_utc_timestamp("ts", "America/Sao_Paulo")
    return table(spark, sf_dir, "events").select("event_id", F.to_date(local).cast("string").alias("local_day"), F.hour(local).alias("local_hour"))


@_R.add("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS has_run, CAST(list_contains(w, 'the') AS INT) + CAST(list_contains(w, 'que') AS INT) + CAST(list_contains(w, 'der') AS INT) AS matched FROM w""")
def identifier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(text.fold_lower(F.col("text")), "[^a-z0-9]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    return rows.select("doc_id", keys.has_run(F.col("w"), F.array(F.lit("of"), F.lit("the"))).alias("has_run"), keys.matched_terms(F.col("w"), ["the", "que", "der"]).alias("matched"))


@_R.add("""
SELECT doc_id, upper(replace(strip_accents(text), 'ß', 'SS')) AS upper_text, CASE WHEN doc_id % 3 = 0 AND regexp_matches(CAST(doc_id AS VARCHAR), '[^7]') THEN lpad(CAST(doc_id AS VARCHAR), 14, '7') END AS tax, 'R$ ' || replace(replace(replace(printf('%,.2f', n_chars / 4.0), ',', '#'), '.', ','), '#', '.') AS brl, 'ação' AS repaired FROM documents""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folding, tax ids of which two thirds are none (as are those of one digit), amounts in words' form and text in the wrong charset."""
    raw = F.expr("CASE doc_id % 3 WHEN 0 THEN lpad(CAST(doc_id AS STRING), 14, '7') WHEN 1 THEN '11111111111111' ELSE '12' END")
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_upper(F.col("text")).alias("upper_text"), text.tax_id_or_null(raw).alias("tax"),
        money.format_money(F.col("n_chars") / 4).alias("brl"), text.repair_mojibake(F.lit("aÃ§Ã£o")).alias("repaired"))


@_R.add("""
SELECT label, count(*) AS unit_vectors FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 GROUP BY label""")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose length is one after normalising."""
    unit = search.normalised(F.col("embedding"))
    length = F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(F.abs(length - 1) < 1e-9).alias("unit_vectors"))


@_R.add("SELECT event_id FROM events WHERE event_id % 7 = 0")
def mirror_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the source no longer has."""
    e = table(spark, sf_dir, "events").select("event_id")
    return quality.mirror_deletions(e, e.filter("event_id % 7 > 0"), "event_id")


@_R.add("SELECT CAST(1 AS BIGINT) AS same_rows, CAST(0 AS BIGINT) AS changed_rows")
def logical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hash of a table stands under reordering and a volatile column, and whether a change of one row leaves it."""
    rows = table(spark, sf_dir, "nation")
    one = quality.table_hash(rows.withColumn("seen", F.lit(1)), ("seen",)).toDF(*[f"a_{i}" for i in range(2)])
    two = quality.table_hash(rows.orderBy(F.desc("n_name")).withColumn("seen", F.lit(2)), ("seen",)).toDF(*[f"b_{i}" for i in range(2)])
    three = quality.table_hash(rows.withColumn("n_name", F.when(F.col("n_nationkey") == 1, "x").otherwise(F.col("n_name"))).withColumn("seen", F.lit(1)), ("seen",)).toDF(*[f"c_{i}" for i in range(2)])
    same = lambda x, y: F.sum((F.col(f"{x}_0").eqNullSafe(F.col(f"{y}_0")) & F.col(f"{x}_1").eqNullSafe(F.col(f"{y}_1"))).cast("bigint"))
    return one.join(two, F.lit(True)).join(three, F.lit(True)).agg(same("a", "b").alias("same_rows"), same("a", "c").alias("changed_rows"))


# Names in words that both engines take.
_RAW = """CASE k % 17 WHEN 0 THEN 'A empresa ' || n || ', inscrita no CNPJ 1' WHEN 1 THEN 'Empresa contratada: ' || n || ' CNPJ nº' WHEN 2 THEN 'CONTRATADA' WHEN 3 THEN 'Empresa ____' WHEN 4 THEN 'x DOCUMENTO DA EMPRESA ' || n WHEN 5 THEN 'Razão Social: ' || n || ', neste ato por y'
 WHEN 6 THEN 'Rua das Flores, 1' WHEN 7 THEN '12.345.678/0001' WHEN 8 THEN 'Prefeitura Municipal' WHEN 9 THEN 'Secretaria Municipal de Obras' WHEN 10 THEN 'OI' WHEN 11 THEN 'ME' WHEN 12 THEN NULL WHEN 13 THEN 'Vencedor(a) do certame' WHEN 14 THEN n || ', doravante contratada' WHEN 15 THEN 'inscrita no CNPJ sob o nº' ELSE '-' || n || ' ];' END"""


def _families_sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    out = "trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g'))"
    for p in suppliers.BEFORE + suppliers.WORDS:
        out = f"regexp_replace({out}, {q(p)}, {q(chr(92) + '1') if '([' in p else q('')}, 'g')"
    name = f"trim(regexp_replace(trim(regexp_replace({out}, '\\s+', ' ', 'g')), {q(suppliers.ENDS)}, '', 'g'))"
    cases = " ".join(f"WHEN regexp_matches(f, {q(p)}) THEN {q(r)}" for r, p in suppliers.INVALID)
    return f"""
WITH r AS (SELECT k, {_RAW} AS raw FROM (SELECT c_custkey AS k, c_name || ' LTDA' AS n FROM customer)), c AS (SELECT k, {name} AS name FROM r), f AS (SELECT k, name, trim(lower(strip_accents(name))) AS f FROM c),
w AS (SELECT k, name, CASE {cases} WHEN length(f) = 1 OR (length(f) = 2 AND f <> 'oi') THEN 'short' END AS reason FROM f) SELECT k, CASE WHEN reason IS NULL THEN name END AS name, reason FROM w"""


@_R.add(_families_sql())
def supplier_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers, cleaned, and why the others are none."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name || ' LTDA' AS n").selectExpr("k", f"{_RAW} AS raw")
    s = suppliers.supplier(F.col("raw"))
    return rows.select("k", F.explode(F.array(s)).alias("s")).select("k", "s.name", "s.reason")
