"""Awards, items, results, earmarks, credits and cited laws out of Portuguese records.

The tables hold no such records, so each query words its own from their columns, in
several forms. The SQL words the same texts and reads them with its own regular
expressions and string functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import NAME_STRIPS, NOT_SUPPLIERS
from ..functions.money import format_money
from ..operators import notices
from ..sources.tables import table
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
OWN = "18557561000151"

# Texts in words that both engines take: id k, firm, tax id, amount m, day d1, day in words d2.
_FIRM = "CASE k % 5 WHEN 0 THEN 'Padaria Pão de Mel Ltda' WHEN 1 THEN 'OFICINA DO ZÉ ME' WHEN 2 THEN 'Gráfica Boa Letra EIRELI' WHEN 3 THEN 'Transportes Serra Azul S/A' ELSE 'Prefeitura Municipal' END"
_CNPJ = "substr(lpad(CAST(k AS VARCHAR(20)), 8, '1'), 1, 2) || '.' || substr(lpad(CAST(k AS VARCHAR(20)), 8, '1'), 3, 3) || '.' || substr(lpad(CAST(k AS VARCHAR(20)), 8, '1'), 6, 3) || '/0001-' || CASE k % 2 WHEN 0 THEN '81' ELSE '05' END"
_MONTH = "CASE mo WHEN 1 THEN 'janeiro' WHEN 2 THEN 'fevereiro' WHEN 3 THEN 'março' WHEN 4 THEN 'abril' WHEN 5 THEN 'maio' WHEN 6 THEN 'junho' WHEN 7 THEN 'julho' WHEN 8 THEN 'agosto' WHEN 9 THEN 'setembro' WHEN 10 THEN 'outubro' WHEN 11 THEN 'novembro' ELSE 'dezembro' END"
_D2 = "CAST(da AS VARCHAR(9)) || ' de ' || month_name || ' de ' || CAST(ye AS VARCHAR(9))"
_AWARD = f"""CASE k % 11
 WHEN 0 THEN 'Foi declarada vencedora a empresa ' || firm || ', no valor global de ' || m || ', adjudicado em ' || d1
 WHEN 1 THEN 'CONTRATO. O Município, inscrito no CNPJ 18.557.561/0001-51, e a empresa ' || firm || ', inscrita no CNPJ sob o nº ' || cnpj || '. Valor do contrato: ' || m
 WHEN 2 THEN 'Empresa contratada: ' || firm || ', inscrita no CNPJ ' || cnpj || '. A contratação tem valor total de ' || m || '. Homologado em ' || d2
 WHEN 3 THEN 'Razão Social: ' || firm || ' Logradouro: Rua A, 10 CNPJ: ' || cnpj || ' Contrato de preço global: ' || m || ' por hora de serviço'
 WHEN 4 THEN 'Termo de contrato com o Município e o Consórcio Via ' || firm || ', formado por duas firmas, inscrito no CNPJ nº ' || cnpj || ', anual de ' || m
 WHEN 5 THEN 'Edital do Pregão. Homologação em ' || d2 || '. Valor total de ' || m
 WHEN 6 THEN 'Edital de credenciamento. Valor do contrato: ' || m || '. PNCP: 18557561000151-1-000' || CAST(10 + k % 90 AS VARCHAR(9)) || '/2024'
 WHEN 7 THEN 'Extrato. Contratada: ' || firm || ' - CNPJ: ' || cnpj || '. Objeto: impressos, valor global de ' || m
 WHEN 8 THEN 'Contratos com X Ltda, inscrita no CNPJ ' || cnpj || ', e Y Ltda, inscrita no CNPJ 88.999.000/0001-11. Valor do contrato: ' || m || '. Homologado: ' || d1
 WHEN 9 THEN 'Nada consta em ' || d1 ELSE 'ATA de ' || d2 || '. Vencedor: ' || firm || '; valor total de ' || m || ' por unidade. Homologada.' END"""


def _words(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """k, text and what the texts are worded from."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), format_money(F.col("o_totalprice").cast("decimal(18,2)")).alias("m"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("d1"),
        F.dayofmonth("o_orderdate").alias("da"), F.month("o_orderdate").alias("mo"), F.year("o_orderdate").alias("ye"))
    o = o.selectExpr("*", f"{_FIRM} AS firm", f"{_CNPJ} AS cnpj", f"{_MONTH} AS month_name").selectExpr("*", f"{_D2} AS d2")
    return o.selectExpr("*", f"{text} AS text")


def _base(text: str) -> str:
    money = "'R$ ' || replace(replace(replace(printf('%,.2f', CAST(o_totalprice AS DECIMAL(18,2))), ',', '#'), '.', ','), '#', '.')"
    return f"""
w0 AS (SELECT o_orderkey AS k, {money} AS m, strftime(o_orderdate, '%d/%m/%Y') AS d1, day(o_orderdate) AS da, month(o_orderdate) AS mo, year(o_orderdate) AS ye FROM orders),
w1 AS (SELECT *, {_FIRM} AS firm, {_CNPJ} AS cnpj, {_MONTH} AS month_name FROM w0), w2 AS (SELECT *, {_D2} AS d2 FROM w1), texts AS (SELECT k, {text} AS t FROM w2)"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _clean(x: str) -> str:
    """A supplier's name in SQL."""
    out = f"trim(lower(strip_accents({x})))"
    for p in NAME_STRIPS:
        out = f"regexp_replace({out}, {_q(p)}, '', 'g')"
    return f"(SELECT CASE WHEN length(z) >= 3 AND NOT regexp_matches(z, {_q(NOT_SUPPLIERS)}) THEN upper(z) END FROM (SELECT {out} AS z))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _awards_sql() -> str:
    ex = lambda x, p, g: f"regexp_extract({x}, {_q(p)}, {g})"
    number = "CAST(replace(replace({0}, '.', ''), ',', '.') AS DOUBLE)"
    named = ", ".join(f"CASE WHEN length({_digits(ex('t', p, 2))}) = 14 AND {_digits(ex('t', p, 2))} <> '{OWN}' THEN {_clean(ex('t', p, 1))} END AS n{i}, {_digits(ex('t', p, 2))} AS c{i}" for i, p in enumerate(notices.SUPPLIERS))
    loose = "CASE " + " ".join(f"WHEN {ex('before', p, 1)} <> '' THEN {_clean(ex('before', p, 1))}" for p in notices.BEFORE_ID) + " END"
    said = ", ".join(_clean(ex("t", p, 1)) for p in notices.DECLARED)
    value = "coalesce(" + ", ".join(
        f"CASE WHEN {ex('t', p, 0)} <> '' AND NOT regexp_matches(substr(t, strpos(t, {ex('t', p, 0)}) + length({ex('t', p, 0)}), 180), {_q(notices.PER_UNIT)})"
        + (" AND origin <> 'notice'" if i >= notices.IN_NOTICES else "") + f" THEN {number.format(ex('t', p, 1))} END" for i, p in enumerate(notices.VALUES)) + ")"
    months = "[" + ", ".join(_q(m) for m in notices.MONTHS) + "]"
    spelled = r"(?i)\b([0-9]{1,2})\s+de\s+([a-zç]+)\s+de\s+([0-9]{4})\b"
    day = f"""CASE WHEN {ex('win', r'[0-9]{2}/[0-9]{2}/[0-9]{4}', 0)} <> '' THEN strptime({ex('win', r'[0-9]{2}/[0-9]{2}/[0-9]{4}', 0)}, '%d/%m/%Y')
 WHEN {ex('win', spelled, 0)} <> '' THEN make_date(CAST({ex('win', spelled, 3)} AS INT), CAST(list_position({months}, lower(strip_accents({ex('win', spelled, 2)}))) AS INT), CAST({ex('win', spelled, 1)} AS INT)) END"""
    return f"""
WITH {_base(_AWARD)},
a AS (SELECT k, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM texts),
b AS (SELECT k, t, lower(strip_accents(t)) AS f, list_filter(list_distinct(list_transform(regexp_extract_all(t, {_q(notices.TAX_ID)}), lambda x: {_digits('x')})), lambda x: x <> '{OWN}') AS ids FROM a),
c AS (SELECT *, CASE WHEN contains(f, 'edital de credenciamento') OR contains(f, 'edital do pregao') THEN 'notice' WHEN contains(f, 'contrat') THEN 'contract' WHEN contains(f, 'ata') THEN 'minutes'
  WHEN regexp_matches(f, 'homolog|adjudic|vencedor') THEN 'approval' ELSE 'notice' END AS origin,
  CASE WHEN len(ids) = 1 THEN ids[1] END AS sole, {named} FROM b),
d AS (SELECT *, coalesce(nullif(strpos(f, 'homolog'), 0), nullif(strpos(f, 'adjudic'), 0)) AS hom, strpos(t, regexp_replace(sole, '^(..)(...)(...)(....)(..)$', '\\1.\\2.\\3/\\4-\\5')) AS place FROM c),
e AS (SELECT *, CASE WHEN hom IS NOT NULL AND origin <> 'notice' THEN substr(t, greatest(hom - 500, 1), hom - greatest(hom - 500, 1) + 1200) END AS win,
  trim(regexp_replace(regexp_replace(substr(t, greatest(place - 240, 1), least(place - 1, 240)), {_q('(?i)\\bCNPJ\\s*:?\\s*' + notices.TAX_ID + '\\s*')}, ' ', 'g'), {_q(notices.ID_WORDS)}, '', 'g')) AS before FROM d),
g AS (SELECT k, origin, coalesce({", ".join(f"CASE WHEN n{i} IS NOT NULL THEN [n{i}, c{i}] END" for i in range(len(notices.SUPPLIERS)))},
  CASE WHEN place > 0 AND {loose} IS NOT NULL THEN [{loose}, sole] END) AS s, coalesce({said}) AS declared, {value} AS value, {day} AS day,
  {ex('t', notices.CONTROLS[1], 1)} AS control FROM e),
h AS (SELECT k, CASE WHEN s IS NOT NULL THEN s[1] ELSE declared END AS winner, CASE WHEN s IS NOT NULL THEN s[2] END AS tax_id, value, strftime(day, '%Y-%m-%d') AS day, CASE WHEN control <> '' THEN regexp_extract(control, '^([0-9]{{14}}-[0-9])-', 1) || '-' || lpad(regexp_extract(control, '-([0-9]+)/', 1), CAST(greatest(6, length(regexp_extract(control, '-([0-9]+)/', 1))) AS INT), '0') || '/' || right(control, 4) END AS control, origin FROM g),
i AS (SELECT *, CAST(winner IS NOT NULL AS INT) + CAST(tax_id IS NOT NULL AS INT) + CAST(value IS NOT NULL AS INT) + CAST(day IS NOT NULL AS INT) + CAST(control IS NOT NULL AS INT) AS found FROM h)
SELECT k, winner, tax_id, value, day, control, origin, least(0.95::DOUBLE, round(0.45 + 0.13 * found, 2)) AS confidence FROM i WHERE found > 0"""


@_R.add(_awards_sql())
def record_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners, values and days of eleven forms of records, some of which name none."""
    return notices.awards(_words(spark, sf_dir, _AWARD), "k", "text", own=(OWN,))


_RESULT = """CASE k % 4
 WHEN 0 THEN 'Item ' || CAST(k % 50 AS VARCHAR(9)) || ' - Vencedor: ' || firm || ', valor ' || m || '. Item 99 - Deserto'
 WHEN 1 THEN 'RESULTADO ' || CAST(1 + k % 30 AS VARCHAR(9)) || ' - Papel A4 | ' || firm || ' ' || m || ' Vencedor 77 - Grampo | X Ltda ' || m || ' Fracassado ENCERRAMENTO 78 - Clipe | Y Ltda ' || m || ' Vencedor'
 WHEN 2 THEN 'ATA. CLASSIFICAÇÃO 1. Caneta Fornecedor Valor Classificação ' || firm || ' ' || m || ' 1º - Lugar 2. Cola Fornecedor Valor Classificação Y Ltda ' || m || ' 1º - Lugar NEGOCIAÇÃO 2. Cola Fornecedor Valor Negociado Valor Vencedor Situação ' || firm || ' R$ 9,00 ' || m || ' Vencedor RECURSOS 1. z'
 ELSE 'Item ' || CAST(k % 50 AS VARCHAR(9)) || ' - Merenda Status: Aprovado 1º SITIO BOM LTDA 22333444000105 ' || m || ' Vencedor Item 51 Status: Deserto 1º X LTDA 11222333000181 R$ 3,45 Vencedor RESULTADO 9 - Y | Z Ltda R$ 1,00 Vencedor' END"""


def _results_sql() -> str:
    ex = lambda x, p, g: f"regexp_extract({x}, {_q(p)}, {g})"
    num = lambda x: f"CAST(replace(replace({x}, '.', ''), ',', '.') AS DOUBLE)"
    split = lambda region, mark: f"unnest(string_split(regexp_replace({region}, {_q(mark)}, chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:])"
    dotted, dashed = r"(?:^|\s)([0-9]{1,4})\.\s+", r"\b([0-9]{1,4})\s*[-–]\s+"
    section = lambda head, ends: f"CASE WHEN {ex('t', head, 0)} <> '' THEN regexp_replace(substr(t, strpos(t, {ex('t', head, 0)}) + length({ex('t', head, 0)})), {_q(r'(?s)\b(?:' + ends + r')\b.*$')}, '', 'g') END"
    ends = notices.SECTION_ENDS
    return f"""
WITH {_base(_RESULT)},
platform AS (SELECT k, {split('t', notices.PLATFORM_MARK)} AS s FROM texts),
p AS (SELECT k, 0 AS rank, 'platform' AS layout, 0.9::DOUBLE AS confidence, CAST({ex('s', '^[0-9]+', 0)} AS INT) AS item, {ex("string_split(s, chr(2))[1]", r"^[0-9]+\s*[-–]\s*(.+)$", 1)} AS description,
  {_clean(ex("string_split(s, chr(2))[2]", notices.PLATFORM_ROW, 1))} AS supplier, {ex("string_split(s, chr(2))[2]", notices.PLATFORM_ROW, 3)} AS m FROM platform WHERE starts_with(lower(trim(string_split(s, chr(2))[2])), 'aprovado')),
n AS (SELECT k, {split(section(r'NEGOCIA\S*O', ends), dotted)} AS s FROM texts), r AS (SELECT k, {split(section(r'CLASSIFICA\S*O', r'NEGOCIA\S*O|' + ends), dotted)} AS s FROM texts),
d AS (SELECT k, {split(section('RESULTADO', r'ENCERRAMENTO|ASSINAM|RECURSOS|OCORR\S*NCIAS'), dashed)} AS s FROM texts), l AS (SELECT k, {split('t', r'(?i)\bitem\s+([0-9]{1,4})\s*[-–:]\s*')} AS s FROM texts),
o AS (
 SELECT k, 1 AS rank, 'negotiated' AS layout, 0.92::DOUBLE AS confidence, s, {ex("b", notices.NEGOTIATED, 1)} AS description, {ex("b", notices.NEGOTIATED, 2)} AS name, {ex("b", notices.NEGOTIATED, 4)} AS m FROM (SELECT *, trim(string_split(s, chr(2))[2]) AS b FROM n) UNION ALL
 SELECT k, 2, 'ranked', 0.88, s, {ex("b", notices.RANKED, 1)}, {ex("b", notices.RANKED, 2)}, {ex("b", notices.RANKED, 3)} FROM (SELECT *, trim(string_split(s, chr(2))[2]) AS b FROM r) UNION ALL
 SELECT k, 3, 'declared', 0.86, s, x[1], CASE WHEN regexp_matches(b, '(?i)\\b[VN]ence\\w*') THEN array_to_string(x[2:], ' ') ELSE '' END, {ex("b", notices.MONEY, 1)}
  FROM (SELECT *, list_filter(list_transform(string_split_regex({ex("b", r"(?is)^(.*?)R\$\s*[0-9.]+,[0-9]{2}", 1)}, '\\s*[|.]\\s*'), lambda y: trim(y)), lambda y: y <> '') AS x FROM (SELECT *, trim(string_split(s, chr(2))[2]) AS b FROM d)) UNION ALL
 SELECT k, 4, 'labelled', 0.8, s, '-', {ex("b", r"(?is)^vencedor[a]?\s*:\s*([^,;|]{3,120}?)\s*(?:[,;|-]|\s+no\s+valor|\s+valor|CNPJ)", 1)}, {ex("b", notices.MONEY, 1)} FROM (SELECT *, trim(string_split(s, chr(2))[2]) AS b FROM l)),
q AS (SELECT k, rank, layout, confidence, CAST({ex('s', '^[0-9]+', 0)} AS INT) AS item, trim(description) AS description, {_clean('name')} AS supplier, m FROM o),
every AS (SELECT * FROM p UNION ALL SELECT * FROM q WHERE k NOT IN (SELECT k FROM p WHERE supplier IS NOT NULL AND m <> '' AND description <> '')),
good AS (SELECT *, {num('m')} AS value FROM every WHERE supplier IS NOT NULL AND m <> '' AND description <> '')
SELECT k, item, layout, description, supplier, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY k, item ORDER BY rank, description, supplier, value) AS nth FROM good WHERE value > 0) WHERE nth = 1"""


@_R.add(_results_sql())
def record_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of items in five layouts."""
    return notices.item_results(_words(spark, sf_dir, _RESULT), "k", "text")


_TABLE = """'Objeto. Item Unid Quant. Especificação 1. ' || CASE k % 4 WHEN 0 THEN 'Kg' WHEN 1 THEN 'Pacote de 500 g' WHEN 2 THEN 'Litro' ELSE 'Peça' END || ' ' || CAST(k % 90 AS VARCHAR(9)) || ' ' || firm ||
 ' 2. Sabão em pó Caixa ' || CASE k % 3 WHEN 0 THEN '1.200' WHEN 1 THEN '12,5' ELSE '0' END || ' sem perfume 3. nada ' || CASE WHEN k % 2 = 0 THEN '2. DA JUSTIFICATIVA 5. Kg 9 não é item' ELSE '4. Und 7 Vassoura de palha' END"""


def _items_sql() -> str:
    ex = lambda p, g: f"regexp_extract(b, {_q(p)}, {g})"
    return f"""
WITH {_base(_TABLE)},
region AS (SELECT k, regexp_replace(substr(t, strpos(t, regexp_extract(t, {_q(notices.ITEM_HEAD)}))), {_q(r'(?is)\b2\.\s+DA\s+JUSTIFICATIVA\b.*$')}, '') AS t FROM texts WHERE regexp_matches(t, {_q(notices.ITEM_HEAD)})),
s AS (SELECT k, unnest(string_split(regexp_replace(t, {_q(r'(?:^|\s)([0-9]{1,4})\.\s+')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))[2:]) AS s FROM region),
b AS (SELECT k, CAST(string_split(s, chr(2))[1] AS INT) AS item, trim(string_split(s, chr(2))[2]) AS b FROM s),
p AS (SELECT k, item, CASE WHEN {ex(notices.UNIT_FIRST, 1)} <> '' THEN [{ex(notices.UNIT_FIRST, 1)}, {ex(notices.UNIT_FIRST, 2)}, {ex(notices.UNIT_FIRST, 3)}] ELSE [{ex(notices.UNIT_INSIDE, 2)}, {ex(notices.UNIT_INSIDE, 3)}, {ex(notices.UNIT_INSIDE, 1)} || ' ' || {ex(notices.UNIT_INSIDE, 4)}] END AS x FROM b)
SELECT k, item, lower(x[1]) AS unit, CAST(replace(replace(x[2], '.', ''), ',', '.') AS DOUBLE) AS quantity, trim(x[3]) AS description FROM p WHERE x[1] <> '' AND CAST(replace(replace(x[2], '.', ''), ',', '.') AS DOUBLE) > 0 AND length(trim(x[3])) >= 3"""


@_R.add(_items_sql())
def record_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of tables in running text, with units before or inside the description."""
    return notices.table_items(_words(spark, sf_dir, _TABLE), "k", "text")


_FORM = """CASE k % 3 WHEN 0 THEN 'Ficha de emendas federais Nº DA EMENDA: 2024' || lpad(CAST(k AS VARCHAR(20)), 8, '0') ELSE 'Emenda parlamentar da Assembleia Legislativa N.º DA EMENDA: Resolução ' || CAST(k % 99 AS VARCHAR(9)) || '/' || CAST(2000 + k % 25 AS VARCHAR(9)) END ||
 ' NOME DO PARLAMENTAR: ' || firm || CASE WHEN k % 2 = 0 THEN ' – Deputado' ELSE '' END || ' OBJETO: Compra de van OBJETO DETALHADO: Van de ' || CAST(k % 40 AS VARCHAR(9)) || ' lugares VALOR DO REPASSE: ' || m || CASE WHEN k % 5 = 0 THEN ' 2 – PLANO DE APLICAÇÃO' ELSE '' END || ' DATA DE RECEBIMENTO DO RECURSO: ' || CASE WHEN k % 4 = 0 THEN d1 ELSE 'a definir' END"""


def _forms_sql() -> str:
    words = "|".join(x.replace(".", r"\.") for x in sorted(notices.LABELS, key=len, reverse=True))
    stop = rf"(?is)\s*(?:(?:^|\s)(?:{words})\s*:|\s[0-9]{{1,2}}\s*[–—-]\s*[A-ZÀ-Ü]).*$"
    field = lambda label: f"nullif(trim(regexp_replace(regexp_extract(t, {_q('(?is)' + label + r'\s*:\s*(.{0,800})')}, 1), {_q(stop)}, '')), '')"
    return f"""
WITH {_base(_FORM)}, e AS (SELECT k, t, coalesce({field('Nº DA EMENDA')}, {field('N[.]º DA EMENDA')}) AS number, {field('NOME DO PARLAMENTAR')} AS who, {field('OBJETO DETALHADO')} AS detail, {field('OBJETO')} AS object, {field('VALOR DO REPASSE')} AS v, {field('DATA DE RECEBIMENTO DO RECURSO')} AS r FROM texts WHERE regexp_matches(t, {_q(notices.EARMARK)}) AND length(t) >= 50)
SELECT k, number, CASE WHEN contains(who, ' – ') THEN string_split(who, ' – ')[1] ELSE who END AS legislator, CASE WHEN contains(who, ' – ') THEN string_split(who, ' – ')[2] END AS role,
 CASE WHEN contains(lower(t), 'emendas federais') THEN 'federal' WHEN contains(lower(t), 'assembleia legislativa') THEN 'state' END AS sphere, object, detail, CAST(replace(replace(regexp_extract(v, '[0-9.]+,[0-9]+'), '.', ''), ',', '.') AS DOUBLE) AS value,
 strftime(try_strptime(r, '%d/%m/%Y'), '%Y-%m-%d') AS received, CAST(coalesce(year(try_strptime(r, '%d/%m/%Y')), CASE WHEN regexp_matches(number, '^20[0-9]{{10}}$') THEN CAST(substr(number, 1, 4) AS BIGINT) ELSE CAST(regexp_extract(number, '/(20[0-9]{{2}})', 1) AS BIGINT) END) AS INT) AS year FROM e"""


@_R.add(_forms_sql())
def record_earmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of earmark forms in one line."""
    return notices.earmarks(_words(spark, sf_dir, _FORM), "k", "text").select("k", "number", "legislator", "role", "sphere", "object", "detail", "value", "received", "year")


_DECREE = """CASE WHEN k % 7 = 0 THEN 'Ofício' ELSE 'DECRETO Nº ' || CAST(k AS VARCHAR(20)) || ', de ' || d2 END || '. Abre Crédito Suplementar no valor total de ' || CASE WHEN k % 2 = 0 THEN m ELSE 'R§' || substr(m, 3, 30) END ||
 CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '. Como recursos fica anulada a dotação' WHEN 2 THEN '. Como recursos o superávit' WHEN 3 THEN '. Como recursos o excesso de arrecadação e a anrúaçáo' ELSE '. Como recursos outros' END"""


@_R.add(rf"""
WITH {_base(_DECREE)}, e AS (SELECT k, t, regexp_extract(t, '(?i)decreto n[º°o]? ?([0-9][0-9./-]*)', 1) AS number, regexp_extract(t, {_q(notices.CREDIT_TOTAL)}, 1) AS v, CASE WHEN contains(t, 'Como recursos') THEN t[strpos(t, 'Como recursos'):] ELSE '' END AS means, regexp_extract_all(t, 'de ([0-9]{{1,2}}) de (\S+) de ([0-9]{{4}})', 0) AS x FROM texts),
f AS (SELECT *, list_filter([CASE WHEN regexp_matches(means, {_q(notices.CREDIT_SOURCES[0][1])}) THEN 'annulment' END, CASE WHEN regexp_matches(means, {_q(notices.CREDIT_SOURCES[1][1])}) THEN 'surplus' END, CASE WHEN regexp_matches(means, {_q(notices.CREDIT_SOURCES[2][1])}) THEN 'excess' END], lambda y: y IS NOT NULL) AS named FROM e)
SELECT k, nullif(number, '') AS number, CASE WHEN len(x) > 0 THEN strftime(make_date(CAST(regexp_extract(x[1], '([0-9]{{4}})$', 1) AS INT), CAST(list_position([{', '.join(_q(m) for m in notices.MONTHS)}], lower(strip_accents(string_split(x[1], ' ')[4]))) AS INT), CAST(string_split(x[1], ' ')[2] AS INT)), '%Y-%m-%d') END AS day,
 CAST(replace(regexp_replace(v, '[ .]', '', 'g'), ',', '.') AS DOUBLE) AS total, CASE WHEN len(named) > 1 THEN 'mixed' ELSE named[1] END AS source FROM f""")
def record_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decrees that open credits, with the scanner's errors."""
    return notices.credits(_words(spark, sf_dir, _DECREE), "k", "text")


_LAW = """CASE k % 5 WHEN 0 THEN 'Altera a Lei nº 1.' || CAST(100 + k % 900 AS VARCHAR(9)) || ', de ' || d2 WHEN 1 THEN 'Conforme Lei Municipal nº 1.' || CAST(100 + k % 300 AS VARCHAR(9)) || '/2012 e Lei Complementar nº 1.111/2015'
 WHEN 2 THEN 'Vista a Lei Ordinária 1' || CAST(100 + k % 900 AS VARCHAR(9)) || '/2013; Lei 1.250/2014' WHEN 3 THEN 'Nos termos da Lei nº 8.666/1993' ELSE 'Sem lei ' || m END"""


@_R.add(f"""
WITH {_base(_LAW)}, c AS (SELECT k, unnest(regexp_extract_all(t, {_q(notices.LAW)}, 0)) AS c FROM texts), laws AS (SELECT DISTINCT CAST(1000 + p_partkey % 600 AS INT) AS number FROM part WHERE p_size % 2 = 0),
n AS (SELECT DISTINCT k, CAST(regexp_replace(regexp_extract(c, {_q(notices.LAW)}, 1), '[^0-9]', '', 'g') AS INT) AS number, CAST(regexp_extract(c, '([0-9]{{4}})$', 1) AS INT) AS year FROM c)
SELECT number, year, count(DISTINCT k) AS n_citing FROM n WHERE number <> 1000 + k % 1000 AND number BETWEEN 1000 AND (SELECT max(number) FROM laws) AND year >= 1995 AND number NOT IN (SELECT number FROM laws) GROUP BY ALL""")
def record_absent_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws that texts cite and the corpus lacks, but for a text's own number."""
    laws = table(spark, sf_dir, "part").filter("p_size % 2 = 0").selectExpr("CAST(1000 + p_partkey % 600 AS INT) AS number")
    return notices.absent_laws(_words(spark, sf_dir, _LAW), "k", "text", F.expr("CAST(1000 + k % 1000 AS INT)"), laws, 1000, 1995)
