"""Records in Portuguese, written by hand, with what a reader finds in them."""

import pytest
from civiledger.operators import notices
from pyspark.sql import functions as F

OWN = ("18557561000151",)


def texts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


AWARDS = [
    # text, attachments, winner, tax id, value, day
    ("Foi declarada vencedora a empresa BETA ME, no valor global de R$ 1.000,00, adjudicado em 01/02/2024", [], "BETA ME", None, 1000.0, "2024-02-01"),
    ("CONTRATO Nº 12/2024\nO Município, CNPJ 18.557.561/0001-51, e a empresa Padaria Pão de Mel Ltda, inscrita no CNPJ sob o nº 11.222.333/0001-81, firmam o presente.\nValor do contrato: R$ 12.345,67", [], "PADARIA PAO DE MEL LTDA", "11222333000181", 12345.67, None),
    ("Empresa contratada: Oficina do Zé, inscrita no CNPJ sob o n° 22.333.444/0001-05. A contratação tem valor total de R$ 950,00. Homologado em 5 de março de 2023.", [], "OFICINA DO ZE", "22333444000105", 950.0, "2023-03-05"),
    ("Razão Social: TRANSPORTES SERRA AZUL Logradouro: Av. Brasil 10 Bairro: Centro CNPJ: 33.444.555/0001-66 Contrato de preço global de R$ 80.000,00 por quilômetro", [], "TRANSPORTES SERRA AZUL", "33444555000166", 80000.0, None),
    ("Contrato: valor global de R$ 4,50 por hora trabalhada, e a empresa Limpa Tudo, com sede na Rua B, 3, Centro, inscrita no CNPJ nº 44.555.666/0001-77", [], "LIMPA TUDO", "44555666000177", None, None),
    ("Termo de contrato celebrado com o Município e o Consórcio Estrada Nova, formado por duas firmas, inscrito no CNPJ sob o nº 55.666.777/0001-88, ao custo anual de R$ 600.000,00", [], "CONSORCIO ESTRADA NOVA", "55666777000188", 600000.0, None),
    ("Edital do Pregão 3/2024. Homologação prevista em 01/09/2024. Valor total de R$ 5.000,00", [], None, None, None, None),
    ("Edital do Pregão 4/2024. Valor do contrato: R$ 7.000,00. Nº de controle PNCP: 18557561000151-1-00012/2024", [], None, None, 7000.0, None),
    ("Extrato. Contratada: Gráfica Boa Letra Ltda - CNPJ: 66.777.888/0001-99. Objeto: impressos.", [], "GRAFICA BOA LETRA LTDA", "66777888000199", None, None),
    ("Contratos com A Ltda, inscrita no CNPJ 77.888.999/0001-00, e B Ltda, inscrita no CNPJ 88.999.000/0001-11. Valor do contrato: R$ 10,00. Homologado em 02/01/2024", ["contrato_a.pdf", "Contrato B.pdf"], None, None, None, "2024-01-02"),
    ("RAZÃO SOCIAL: AÇÚCAR DOCE LTDA LOGRADOURO: RUA É CNPJ: 33.444.555/0001-66. A CONTRATAÇÃO TEM VALOR TOTAL DE R$ 950,00. HOMOLOGADO EM 5 DE MARÇO DE 2023.", [], "ACUCAR DOCE LTDA", "33444555000166", 950.0, "2023-03-05"),
    ("CONTRATO. VALOR GLOBAL DE R$ 7,00 POR MÊS", [], None, None, None, None),
    ("Nada consta.", [], None, None, None, None),
    (None, None, None, None, None, None),
]


def test_awards_as_a_reader_finds_them(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, *_) in enumerate(AWARDS)], "id int, text string, files array<string>")
    got = {r["id"]: r for r in notices.awards(rows, "id", "text", F.col("files"), OWN).collect()}
    for i, (text, _, winner, tax_id, value, day) in enumerate(AWARDS):
        r = got.get(i)
        have = (r["winner"], r["tax_id"], r["value"], r["day"]) if r else (None,) * 4
        assert have == (winner, tax_id, value, day), (text, have)
    assert not {6, 11, 12, 13} & set(got)
    assert got[7]["control"] == "18557561000151-1-000012/2024" and got[7]["confidence"] == 0.71 and got[7]["origin"] == "notice"
    assert got[1]["confidence"] == 0.84 and got[2]["confidence"] == 0.95


def test_item_tables(spark):
    got = notices.table_items(texts_of(spark, [
        "Termo de Referência. Item Unid Quant. Especificação\n1. Kg 12,5 Arroz tipo 1, pacote\n2. Pacote de 500 g 1.200 Café torrado e moído\n3. Sabão em pó Caixa 40 sem perfume 4. sem quantidade 2. DA JUSTIFICATIVA 5. Kg 9 não é item",
        "Item Unid Quant. sem cabeçalho 1. Kg 3 nada", None,
    ]), "id", "text").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, "kg", 12.5, "Arroz tipo 1, pacote"), (0, 2, "pacote de 500 g", 1200.0, "Café torrado e moído"), (0, 3, "caixa", 40.0, "Sabão em pó sem perfume")]


RESULTS = [
    "Item 1 - Vencedor: ALFA LTDA, valor unitário R$ 10,00. Item 2 - Vencedora: Beta Comércio no valor de R$ 1.020,50",
    "ATA. CLASSIFICAÇÃO 1. Caneta azul Fornecedor Valor Classificação GAMA ME R$ 2,00 1º - Lugar DELTA R$ 3,00 2º - Lugar 2. Lápis Fornecedor Valor Classificação ZETA LTDA R$ 1,50 1º - Lugar "
    "NEGOCIAÇÃO 1. Caneta azul Fornecedor Valor Negociado Valor Vencedor Situação GAMA ME R$ 1,90 R$ 1,80 Vencedor HABILITAÇÃO 9. x",
    "RESULTADO 1 - Papel A4 | Papelaria Sol Ltda R$ 25,00 Vencedor 2 - Grampo | Papelaria Lua R$ 5,00 Fracassado ENCERRAMENTO 3 - Clipe | X Ltda R$ 1,00 Vencedor",
    "Item 1 - Merenda Status: Aprovado 1º COOPERATIVA CAMPO VERDE 11222333000181 R$ 3,45 Vencedor Item 2 Status: Deserto 1º X LTDA 11222333000181 R$ 3,45 Vencedor "
    "Lote 3 Status: Aprovado Descrição complementar: frutas Quantidade: 3 1° SITIO BOM LTDA 22333444000105 7,0000 Vencedor RESULTADO 9 - Y | Z Ltda R$ 1,00 Vencedor",
    "Sem itens", None,
]


def test_item_results_in_all_layouts(spark):
    got = {(r["id"], r["item"]): (r["layout"], r["supplier"], r["value"], r["description"]) for r in notices.item_results(texts_of(spark, RESULTS), "id", "text").collect()}
    assert got == {
        (0, 1): ("labelled", "ALFA LTDA", 10.0, "-"), (0, 2): ("labelled", "BETA COMERCIO", 1020.5, "-"),
        (1, 1): ("negotiated", "GAMA ME", 1.8, "Caneta azul"), (1, 2): ("ranked", "ZETA LTDA", 1.5, "Lápis"),
        (2, 1): ("declared", "PAPELARIA SOL LTDA", 25.0, "Papel A4"),
        (3, 1): ("platform", "COOPERATIVA CAMPO VERDE", 3.45, "Merenda"), (3, 3): ("platform", "SITIO BOM LTDA", 7.0, "frutas"),
    }


def test_earmark_forms(spark):
    form = (
        "EMENDA PARLAMENTAR - Emendas Federais Nº DA EMENDA: 202539600001 NOME DO PARLAMENTAR: João da Silva – Deputado Federal PARTIDO DO PARLAMENTAR: ABC TIPO DE EMENDA: Individual OBJETO: Compra de van "
        "OBJETO DETALHADO: Van de 16 lugares para a saúde VALOR DO REPASSE: R$ 250.000,00 VALOR DA CONTRAPARTIDA: R$ 1.000,50 DATA DE RECEBIMENTO DO RECURSO: 10/03/2024 2 – PLANO DE APLICAÇÃO INÍCIO: 01/04/2024"
    )
    state = "Ficha da emenda parlamentar recebida da Assembleia Legislativa. N.º DA EMENDA: Resolução 12/2023\nNOME DO PARLAMENTAR: Maria Souza\nOBJETO: Reforma da escola"
    got = {r["id"]: r for r in notices.earmarks(texts_of(spark, [form, state, "OBJETO: nada de emenda aqui, só um texto que é comprido o bastante", "emenda parlamentar curta", None]), "id", "text").collect()}
    assert set(got) == {0, 1}
    r = got[0]
    assert (r["number"], r["legislator"], r["role"], r["party"], r["sphere"], r["kind"]) == ("202539600001", "João da Silva", "Deputado Federal", "ABC", "federal", "Individual")
    assert (r["object"], r["detail"], r["value"], r["own_value"], r["received"], r["starts"], r["year"]) == ("Compra de van", "Van de 16 lugares para a saúde", 250000.0, 1000.5, "2024-03-10", "2024-04-01", 2024)
    r = got[1]
    assert (r["number"], r["legislator"], r["role"], r["sphere"], r["object"], r["value"], r["year"]) == ("Resolução 12/2023", "Maria Souza", None, "state", "Reforma da escola", None, 2023)


def test_credits_as_scanned(spark):
    texts = [
        "DECRETO Nº 1.234, de 5 de maio de 2022. Abre Crédito Suplementar no valor total de R$ 10.518,00. Art. 2º Como recursos fica anulada a dotação.",
        "Decreto n 77 de 12 de março de 2021 Credito  Suplementar no valor total de R§ 1 .518, 00 Como recursos será utilizado o superavit e a anrúaçáo", "Crédito Suplementar no valor total de RS 9,99 Como recursos o excesso de arrecadação", "Sem decreto", None,
    ]
    got = {r["id"]: (r["number"], r["day"], r["total"], r["source"]) for r in notices.credits(texts_of(spark, texts), "id", "text").collect()}
    assert got == {0: ("1.234", "2022-05-05", 10518.0, "annulment"), 1: ("77", "2021-03-12", 1518.0, "mixed"), 2: (None, None, 9.99, "excess")}


def test_cited_laws(spark):
    rows = spark.createDataFrame([
        (1, 1315, "Altera a Lei nº 1.315, de 12 de março de 2014, e a Lei Municipal nº 1.200/2012. Conforme Lei nº 8.666/1993 e a Lei Complementar nº 1.111/2015."),
        (2, None, "Vistas as Leis e a Lei Ordinária Municipal 1.200/2012; Lei 1.315, de 12 de março de 2014"), (3, 3, None),
    ], "id int, number int, text string")
    cited = {tuple(r) for r in notices.law_citations(rows, "id", "text", F.col("number")).collect()}
    assert cited == {(1, 1200, 2012), (1, 8666, 1993), (2, 1200, 2012), (2, 1315, 2014)}
    laws = spark.createDataFrame([(1315,), (1400,)], "number int")
    assert [tuple(r) for r in notices.absent_laws(rows, "id", "text", F.col("number"), laws).collect()] == [(1200, 2012, 2)]


@pytest.mark.parametrize("text, day", [("em 31/02/2024", None), ("dia 3 de Março de 2024", "2024-03-03"), ("1 de março de 2024 e 05/06/2023", "2023-06-05"), ("2 de marte de 2024", None), ("", None)])
def test_dates(spark, text, day):
    assert texts_of(spark, [text]).select(notices.spelled_date(F.col("text")).cast("string")).first()[0] == day


@pytest.mark.parametrize("raw, name, reason", [
    ("A empresa Padaria  Sol Ltda, inscrita no CNPJ sob o nº 1", "Padaria Sol Ltda", None), ("EMPRESA CONTRATADA: ALFA - CNPJ nº", "ALFA", None), ("Prefeitura Municipal de Vila Nova - MG Beta ME", "Beta ME", None),
    ("lote 3 DOCUMENTO DO REPRESENTANTE Gama S/A, neste ato representada", "Gama S/A", None), ("Contratada Razão Social: Ção Ltda", "Ção Ltda", None), ("Município de Vila Nova", None, "public body"),
    ("Fundo Municipal de Saúde", None, "public body"), ("LICITANTES", None, "placeholder"), ("Empresa ____", None, "placeholder"), ("CNPJ sob o nº", None, "empty"), ("Bairro Centro", None, "address"), ("36.300 - 123", None, "address"),
    ("x", None, "short"), ("Oi", "Oi", None), ("undefined", None, "empty"), (None, None, "empty"), ("  ", None, "empty"),
])
def test_suppliers_names(spark, raw, name, reason):
    from civiledger.functions import suppliers

    got = spark.createDataFrame([(raw,)], "c string").select(suppliers.supplier(F.col("c"), "vila nova").alias("s")).first()["s"]
    assert (got["name"], got["reason"]) == (name, reason)
