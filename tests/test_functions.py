"""Column functions at their boundaries."""

import datetime

from civiledger.functions import dates, money, text
from civiledger.operators import rules
from civiledger.sources import files
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_text(spark):
    c = F.col("c")
    assert one(spark, text.slug(c), c=" São João — Nº 5! ") == "sao-joao-n-5"
    assert one(spark, text.payee_key(F.lit("12.345.678/0001-95"), c), c="x") == "12345678000195"
    assert one(spark, text.payee_key(F.lit(None).cast("string"), c), c="Ana Lu") == "pf-ana-lu"
    assert one(spark, text.tax_id_or_null(c), c="111.111.111-11") is None
    assert one(spark, text.tokens(c), c="Obra da ponte, ponte nova") == ["obra", "ponte", "nova"]
    assert one(spark, text.sorted_token_key(c), c="ponte nova obra") == "nova obra ponte"
    assert one(spark, text.jaccard(text.tokens(c), text.tokens(F.lit("obra nova"))), c="obra ponte") == 1 / 3
    assert one(spark, text.overlap(text.tokens(c), text.tokens(F.lit("obra"))), c="obra ponte") == 1.0
    assert one(spark, text.jaccard(text.tokens(c), text.tokens(c)), c="") == 0.0
    assert one(spark, text.repair_mojibake(c), c="licitaÃ§Ã£o") == "licitação"
    assert one(spark, text.repair_mojibake(c), c="maçã") == "maçã"
    assert one(spark, text.chunks(c, 4, 1), c="abcdefghij") == ["abcd", "defg", "ghij"]
    assert one(spark, text.chunks(c, 4, 1), c="") == []
    assert one(spark, text.numeric_signature(c), c="lote 2, 10 un, lote 2") == ["10", "2"]
    assert one(spark, text.mask(c), c="a.b@c.org (11) 98888-7777 123.456.789-09") == "[email] [phone] [cpf]".replace("] [phone", "][phone")
    assert one(spark, text.compatible_titles(c, F.lit("Compra ponte 2/2021")), c="Compra ponte 1/2021") is False
    assert one(spark, text.excerpt(c, "alvo", 3), c="xx yy  alvo zz") == "y alvo zz"


def test_money(spark):
    c = F.col("c")
    assert float(one(spark, money.parse_money(c), c="R$ 1.234,56")) == 1234.56
    assert one(spark, money.parse_money(c), c="abc") is None
    assert one(spark, money.half_up(c), c=-2.5) == -2.0
    assert one(spark, money.format_money(c), c=1234.5) == "R$ 1.234,50"
    assert one(spark, money.plausibility(c), c=99.0) == "low"
    assert [float(x) for x in one(spark, money.amounts(c), c="de R$ 10,00 a R$ 1.000,50")] == [10.0, 1000.5]
    assert one(spark, money.compared(c, F.lit(100.0), 1, 0.02), c=101.5) == "approx"
    assert one(spark, money.best_value(F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"), c, F.lit(3.0)), c=2.0) == 6.0


def test_dates(spark):
    c = F.col("c")
    assert one(spark, dates.parse_date(c), c="31/12/2024") == datetime.date(2024, 12, 31)
    assert one(spark, dates.parse_date(c), c="2024-02-30") is None
    assert one(spark, dates.term_start(c), c=2024) == 2021
    assert one(spark, dates.term_label(dates.term_start(c)), c=2025) == "2025-2028"
    assert one(spark, dates.add_months_rolling(c.cast("date"), 1), c="2023-01-31") == datetime.date(2023, 3, 3)
    assert one(spark, dates.inferred_year(c), c="de 1999 a 2021, nº 123456") == 2021
    for d in ("2023-01-01", "2024-12-31", "2018-01-01"):
        assert one(spark, dates.week_of_year(c.cast("date")), c=d) == int(datetime.date.fromisoformat(d).strftime("%W"))


def test_notice_fields(spark):
    docs = spark.createDataFrame([(1, "Pregão nº 3. Processo nº 12/2021. Abertura dia 01/02/2021. Objeto: compra de materiais diversos."), (2, "")], "id int, t string")
    first, second = rules.notice_fields(docs, "id", "t").orderBy("id").collect()
    assert (first["modality"], first["process"], first["opening"], first["confidence"]) == ("pregao", "12/2021", "01/02/2021", 1.0)
    assert second["confidence"] == 0.0 and second["object"] is None


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v\n1;2.5\nx;3\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, v double").orderBy("v").collect()
    assert (rows[0]["id"], rows[0]["_corrupt"], rows[1]["_corrupt"]) == (1, None, "x;3")
    (tmp_path / "a.json").write_text('{"id": 1}\n{bad\n')
    assert sorted(r["_corrupt"] or "" for r in files.read_json_lines(spark, str(tmp_path / "a.json"), "id int").collect()) == ["", "{bad"]
    lines = [(1, i, s) for i, s in enumerate(["title", "item | descrição | qty | unit price", "1 | cadeira | 10 | 1.234,50", "2 | mesa | | ", "total"])]
    got = files.sheet_rows(spark.createDataFrame(lines, "sheet_id int, line_no int, line string")).collect()
    assert [(r["description"], float(r["quantity"]), float(r["price"])) for r in got] == [("cadeira", 10.0, 1234.5)]
