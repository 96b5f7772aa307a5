"""Payroll reports as files hold them, and the view of a process' items, row by row."""

import random
import re
import unicodedata

import pytest
from civiledger.operators import extract, items

REPORT = '''"Folha Salarial - Dezembro / 2024","","","",""
"","","","",""
"Vínculo: 0000004 / Matrícula: 31","Nome: ANA ""NINA"" PRADO","CPF : ***.111222-**","Situação: Ativo",""
"Outras Informações","","","",""
"Forma de Admissão: Concursado","Cargo: PROFESSORA","Função: ","",""
"Secretaria: EDUCACAO","Salário base: 2500.00","Competência: 13/2024","Carga horária semanal/plantões: 30",""
"Lotação: ESCOLA DO CAMPO","Sigla do Cargo: PROF","Data de Admissão: 02/02/2010","",""
"17","FORA DA TABELA","","1.00",""
"Cód","Descrição","Referência","Proventos","Descontos"
"001","VENCIMENTO"," 30","2500.00",""
"020","I.N.S.S."," 1100","","1.275,50"
" Remuneração Bruta: 2500.00
   Total da Remuneração Após Deduções: 1224.50 ","","","",""
"99","DEPOIS DO RODAPE","","1.00",""
"Vínculo: 5 / Matrícula: 32","Nome: SEM RODAPE","CPF : x","Situação: Ativo",""
"Secretaria: OBRAS","Salário base: 1.00","Competência: 12/2024","Carga horária semanal/plantões: 40",""
"Vínculo: 6 / Matrícula: 33","Nome: JOAO","CPF : y","Situação: Férias",""
" Remuneração Bruta: 9.00
","","","",""'''


@pytest.mark.parametrize("chunk", [1, 3, 50_000])
def test_payroll_report(spark, chunk):
    rows = [(f, i, x) for f in (1, 2) for i, x in enumerate(REPORT.split("\n"))]
    got = extract.payroll_records(spark.createDataFrame(rows, "file int, number int, line string").repartition(3), "file", "number", "line", chunk).orderBy("file", "registration").collect()
    assert [(r["file"], r["registration"]) for r in got] == [(1, "31"), (1, "33"), (2, "31"), (2, "33")]
    r = got[0]
    assert (r["bond"], r["year"], r["month"], r["name"], r["masked_id"], r["status"]) == ("0000004", 2024, 13, 'ANA "NINA" PRADO', "***.111222-**", "Ativo")
    assert (r["admission"], r["job"], r["function"], r["department"], r["assignment"], r["job_code"], r["admitted_on"], r["hours"]) == ("Concursado", "PROFESSORA", None, "EDUCACAO", "ESCOLA DO CAMPO", "PROF", "02/02/2010", "30")
    assert (r["base_salary"], r["gross"], r["net"]) == (2500.0, 2500.0, 1224.5)
    assert [tuple(x) for x in r["rubrics"]] == [("001", "VENCIMENTO", "30", 2500.0, None), ("020", "I.N.S.S.", "1100", None, 1275.5)]
    assert (got[1]["gross"], got[1]["net"], got[1]["rubrics"], got[1]["status"]) == (9.0, None, [], "Férias")
    assert {f.split(" ")[0] for f in extract.PAYROLL.split(", ")} == set(got[0].asDict()) - {"file"}


def test_running_sums_over_chunks(spark):
    r = random.Random(1)
    rows = [(f, i * 3, r.randint(-5, 5)) for f in "ab" for i in range(50)]
    frame = spark.createDataFrame(rows, "file string, number int, v int").repartition(4)
    from pyspark.sql import functions as F

    for chunk in (1, 7, 1000):
        got = {(x["file"], x["number"]): x["s"] for x in extract.running_sum(frame, "file", "number", F.col("v"), "s", chunk).collect()}
        assert got == {(f, n): sum(v for g, m, v in rows if g == f and m <= n) for f, n, _ in rows}


def plain_view(rows):
    """The richest row of each thing, gone through in order of id."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()
    held, first = {}, {}
    for x in sorted(rows, key=lambda x: x["id"]):
        clean = (x["description"] or "").strip()
        for p in items.LEAKS:
            clean = re.sub(p, "", clean).strip()
        if not re.search("[A-Za-zÀ-ÿ]", clean):
            role, key = items.DROPPED, x["id"]
        elif x["final_kind"] == "global" or (x["whole_final"] or 0) > 0:
            role, key = items.WHOLE, fold(clean)
        elif x["final_kind"] == "lote" or (x["lot_final"] or 0) > 0:
            role, key = items.LOT, ("L", x["lot"]) if x["lot"] else ("D", fold(clean))
        else:
            role, key = items.ITEM, (x["item"] or "", fold(clean))
        rich = 4 * bool(x["supplier"]) + 3 * any(x[c] for c in ("lot_final", "total_final", "unit_final", "whole_final")) + 2 * ("ata_resultado" in (x["origin"] or "")) + bool(x["quantity"])
        at = (x["process"], role, key)
        first.setdefault(at, x["id"])
        if at not in held or rich > held[at][0]:
            held[at] = (rich, x["id"])
    out = {}
    for (process, role, key), (_, i) in held.items():
        whole = min(v for (p, r, _), v in first.items() if p == process and r == items.WHOLE) if role == items.WHOLE else None
        if role != items.WHOLE or first[process, role, key] == whole:
            out[i] = role
    return out


def test_item_view_against_a_plain_scan(spark):
    r = random.Random(3)
    pick = r.choice
    names = [c.split()[0] for c in items.COLUMNS.split(", ")]
    rows = [dict(zip(names, (i % 6, i, pick([None, "1", "2"]), pick([None, "", "1"]), pick([None, "", "5091", "Óleo  e-mail: a", "oleo", "| 12,3 1.5", "CD-RW", "7 & resto", "Papel fornecedor  valor"]), pick([None, 0.0, 2.0]), "un", pick([None, 3.0]), None,
            pick([None, 0.0, 4.0]), pick([None, 5.0]), pick([None, None, 6.0]), pick([None, None, None, 7.0]), pick([None, None, "lote", "global"]), pick([None, "", "ALFA"]), pick([None, "ata_resultado", "ia"])), strict=True)) for i in range(400)]
    frame = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], items.COLUMNS).repartition(4)
    view = items.item_view(frame).cache()
    got = {x["id"]: x["role"] for x in view.collect()}
    assert got == plain_view(rows) and set(got.values()) == {items.ITEM, items.LOT, items.WHOLE, items.DROPPED}
    for x in view.filter("role = 'dropped'").collect():
        assert x["reason"] == ("leak" if (x["description"] or "").strip() not in ("", x["clean"]) else "no content")
    covered = {x["process"]: x for x in items.view_coverage(view).collect()}
    for p, x in covered.items():
        own = [v for v in view.collect() if v["process"] == p]
        assert (x["n_items"], x["n_lots"], x["n_dropped"]) == tuple(sum(v["role"] == r_ for v in own) for r_ in (items.ITEM, items.LOT, items.DROPPED)) and x["only_demand"] == (x["n_items"] > 0 and not x["has_result"])
