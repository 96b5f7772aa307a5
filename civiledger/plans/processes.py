"""Payroll reports and the items of processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, items
from ..sources.tables import table
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
# Reports in words that both engines take: lines parted by ~, one report a nation, one block a customer.
_AMOUNT = "CAST(CAST(floor(c) AS BIGINT) AS VARCHAR(20)) || '.' || CAST(10 + k % 90 AS VARCHAR(9))"
_BLOCK = f"""'"Folha Salarial - Janeiro / 2025","","","",""~"","","","",""~"Vínculo: 00' || CAST(k AS VARCHAR(20)) || ' / Matrícula: ' || CAST(k * 7 AS VARCHAR(20)) || '","Nome: ' || n || '","CPF : ***.' || CAST(100000 + k AS VARCHAR(20)) || '-**","Situação: ' || CASE WHEN k % 3 = 0 THEN 'Ativo' ELSE 'Afastado' END || '",""~"Forma de Admissão: Efetivo","Cargo: ' || m || ', "" chefe"" x","Função: X","",""~"Secretaria: FAZENDA","Salário base: ' || {_AMOUNT} || '","Competência: ' || CASE k % 13 WHEN 12 THEN '13' ELSE lpad(CAST(1 + k % 13 AS VARCHAR(9)), 2, '0') END || '/2025","Carga horária semanal/plantões: 40",""~"Lotação: SEDE","Sigla do Cargo: E","Data de Admissão: 18/01/1991","",""~"Cód","Descrição","Referência","Proventos","Descontos"~"001","VENCIMENTO"," 30","' || {_AMOUNT} || '",""~' ||
 CASE WHEN k % 2 = 0 THEN '"020","I.N.S.S."," 1400","","' || CAST(k % 50 AS VARCHAR(9)) || '.5"~' ELSE '' END || CASE WHEN k % 5 = 0 THEN '' ELSE '" Remuneração Bruta: ' || {_AMOUNT} || '~   Total da Remuneração Após Deduções: ' || {_AMOUNT} || ' ","","","",""' END"""


@_R.add(f"""
WITH b AS (SELECT k, f, c, {_BLOCK} AS t FROM (SELECT c_custkey AS k, c_nationkey AS f, c_name AS n, c_mktsegment AS m, abs(c_acctbal) AS c FROM customer)),
x AS (SELECT f AS file, regexp_extract(t, 'Matrícula: ([0-9]+)', 1) AS registration, regexp_extract(t, 'Nome: ([^"]+)"', 1) AS name, regexp_extract(t, 'Situação: ([^"]+)"', 1) AS status, replace(regexp_extract(t, '"Cargo: (.*?)","Função', 1), '""', '"') AS job,
 regexp_extract(t, 'Competência: ([0-9]{{2}})', 1) AS month, regexp_extract(t, 'Salário base: ([0-9.]+)', 1) AS salary, regexp_extract(t, 'Remuneração Bruta: ([0-9.]+)', 1) AS gross, regexp_extract(t, 'Deduções: ([0-9.]+)', 1) AS net, regexp_extract_all(t, '"[0-9]{{3}}","[^~]*"') AS rubrics FROM b)
SELECT file, registration, CAST(month AS INT) AS month, name, status, job, CAST(salary AS DOUBLE) AS base_salary, CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net,
 array_to_string(list_transform(rubrics, lambda r: string_split(r, '","')[1][2:] || '/' || string_split(r, '","')[2] || '/' || coalesce(string_split(r, '","')[4], '') || '/' || replace(string_split(r, '","')[5], '"', '')), ' ') AS rubrics FROM x WHERE gross <> ''""")
def payroll_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of payroll reports: one report a nation, one record a customer, a fifth of them cut off before their footer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("file"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("m"), F.abs("c_acctbal").alias("c"))
    lines = c.select("k", "file", F.posexplode(F.split(F.expr(_BLOCK), "~")).alias("i", "line")).withColumn("number", F.col("k") * 100 + F.col("i"))
    got = extract.payroll_records(lines.select("file", "number", "line"), "file", "number", "line", 10_000)
    said = lambda x: F.when(x.isNull(), "").otherwise(F.regexp_replace(x.cast("decimal(18,2)").cast("string"), r"(\.[0-9]*?[1-9])0$|\.00$", "$1"))
    listed = F.array_join(F.transform("rubrics", lambda r: F.concat_ws("/", r["code"], r["description"], said(r["earnings"]), said(r["deductions"]))), " ")
    return got.select("file", "registration", "month", "name", "status", "job", "base_salary", "gross", "net", listed.alias("rubrics"))


_ITEM = """l_orderkey AS process, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, CASE WHEN l_linenumber % 5 > 0 THEN CAST(l_linenumber % 3 AS VARCHAR(9)) END AS item, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 3 AS VARCHAR(9)) END AS lot,
 CASE l_partkey % 7 WHEN 0 THEN '5091' WHEN 1 THEN 'Óleo E-mail: x@y' WHEN 2 THEN 'óleo' WHEN 3 THEN '12 & x' WHEN 4 THEN 'Papel Fornecedor Valor 3' WHEN 5 THEN '' ELSE 'CD-RW' END AS description, CASE WHEN l_quantity > 10 THEN l_quantity END AS quantity, 'un' AS unit,
 CASE WHEN l_discount > 0.05 THEN l_tax END AS unit_estimate, CASE WHEN l_tax > 0.06 THEN l_discount END AS total_estimate, CASE WHEN l_suppkey % 3 = 0 THEN l_extendedprice END AS unit_final, CASE WHEN l_suppkey % 7 = 0 THEN l_extendedprice * 2 END AS total_final,
 CASE WHEN l_suppkey % 11 = 0 THEN 5.0 END AS lot_final, CASE WHEN l_suppkey % 13 = 0 THEN 0.0 WHEN l_suppkey % 13 = 1 THEN 9.0 END AS whole_final, CASE l_suppkey % 17 WHEN 0 THEN 'lote' WHEN 1 THEN 'global' END AS final_kind, CASE WHEN l_partkey % 2 = 0 THEN 'ALFA' END AS supplier, CASE WHEN l_linenumber % 2 = 0 THEN 'ata_resultado_x' ELSE 'ia' END AS origin"""
_LEAKS = ["e-?mail\\s*:", "à\\s*vista\\s*da\\s*habilita", "valor\\s*global\\s*da\\s*proposta", "fornecedor\\s+valor", "classifica[çc][aã]o\\s+posi[çc][aã]o"]


@_R.add(f"""
WITH p AS (SELECT {_ITEM} FROM lineitem), c AS (SELECT *, trim(regexp_replace(regexp_replace(trim(description), '(?is)\\s*[-–]?\\s*(?:{'|'.join(_LEAKS)}).*', ''), '(?s)\\s*[0-9]+\\s+&.*', '')) AS clean FROM p),
r AS (SELECT *, CASE WHEN NOT regexp_matches(clean, '[A-Za-zÀ-ÿ]') THEN 'dropped' WHEN final_kind IS NOT DISTINCT FROM 'global' OR whole_final > 0 THEN 'whole result' WHEN final_kind IS NOT DISTINCT FROM 'lote' OR lot_final > 0 THEN 'lot result' ELSE 'item' END AS role,
  CASE WHEN supplier <> '' THEN 4 ELSE 0 END + CASE WHEN coalesce(lot_final, 0) <> 0 OR coalesce(total_final, 0) <> 0 OR coalesce(unit_final, 0) <> 0 OR coalesce(whole_final, 0) <> 0 THEN 3 ELSE 0 END + CASE WHEN contains(origin, 'ata_resultado') THEN 2 ELSE 0 END + CASE WHEN coalesce(quantity, 0) <> 0 THEN 1 ELSE 0 END AS rich FROM c),
s AS (SELECT *, CASE role WHEN 'item' THEN coalesce(item, '') || '|' || lower(strip_accents(clean)) WHEN 'lot result' THEN CASE WHEN lot IS NOT NULL THEN 'L' || lot ELSE 'D' || lower(strip_accents(clean)) END WHEN 'whole result' THEN lower(strip_accents(clean)) ELSE CAST(id AS VARCHAR) END AS same FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY process, role, same ORDER BY rich DESC, id) AS nth, min(id) OVER (PARTITION BY process, role, same) AS first_id, min(CASE WHEN role = 'whole result' THEN id END) OVER (PARTITION BY process) AS whole_id FROM s)
SELECT process, id, role, clean, CASE WHEN role = 'item' THEN coalesce(total_estimate, unit_estimate * quantity, unit_estimate) END AS estimate,
 CASE role WHEN 'item' THEN CASE WHEN coalesce(final_kind, '') NOT IN ('lote', 'global') THEN coalesce(total_final, unit_final) END WHEN 'lot result' THEN lot_final WHEN 'whole result' THEN whole_final END AS result,
 CASE WHEN role = 'dropped' THEN CASE WHEN trim(description) <> '' AND trim(description) <> clean THEN 'leak' ELSE 'no content' END END AS reason FROM k WHERE nth = 1 AND (role <> 'whole result' OR first_id = whole_id)""")
def process_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of processes as items, lot results, one whole result and what is dropped, the richest of repeated ones."""
    rows = spark.sql(f"SELECT {_ITEM} FROM {{lines}}", lines=table(spark, sf_dir, "lineitem"))
    return items.item_view(rows).select("process", "id", "role", "clean", "estimate", "result", "reason")
