"""Hand-made pages with single quotes, nested lists, spans and ends left out."""

import pytest
from civiledger.plans import catalogue
from civiledger.sources import markup
from comparing import SF, duck_rows, rows_of
from pyspark.sql import functions as F


def read(spark, *pages, tags=()):
    return markup.elements(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html", tags).cache()


def test_elements_of_a_page(spark):
    found = read(spark, "<!-- <b>no</b> --><P class='a  b' title=\"x > y\">one <b>two</b><br/>three<p id=z>four &amp; &eacute;<script>'<p>'</script>", None, "", "plain < text", "<ul><li>a<ul><li>b</ul><li>c</ul></div>")
    rows = {(r["id"], r["node"]): r for r in found.collect()}
    p, b, z = rows[0, 0], rows[0, 1], rows[0, 3]
    assert (p["tag"], p["classes"], p["attributes"]["title"], p["text"], p["own_text"]) == ("p", ["a", "b"], "x > y", "one two three", "one three")
    assert (b["text"], b["ancestors"], b["parent"]) == ("two", [0], 0) and (z["text"], z["parent"], z["attributes"]) == ("four & é", None, {"id": "z"})
    assert {k[0] for k in rows} == {0, 4}
    items = [(r["depth"], r["own_text"], r["text"]) for r in markup.list_items(found.filter("id = 4"), "id").orderBy("node").collect()]
    assert items == [(1, "a", "a b"), (2, "b", "b"), (1, "c", "c")]
    assert [r["tag"] for r in read(spark, "<p>a<b>c</b></p>", tags=("b",)).collect()] == ["b"]


def test_references_without_their_semicolon(spark):
    page = "<div class='ad' title='a&amp;b&copy=1'>x &amp;&amp &#38; &eacute &notit; &lt;p&gt; &</div>"
    rows = spark.createDataFrame([(0, page)], "id int, html string")
    ended, plain = (markup.elements(rows, "id", "html", (), ended=e).first() for e in (True, False))
    assert (ended["text"], ended["attributes"]["title"]) == ("x &&amp & &eacute &notit; <p> &", "a&b&copy=1")
    assert plain["text"] == "x && & é ¬it; <p> &"


def test_outlines_of_pages_with_cut_references(spark, duck, tmp_path):
    html = "<html><head><title>a &amp b</title></head><body><h1>c&&amp</h1><div class=\"ad\">d&lt e&amp;f</div><p>g<a href=\"/h?i&amp=1\">j&gt k</a></body></html>"
    spark.createDataFrame([(1, "http://x.y/z", html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    own = duck.cursor()
    own.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_outlines", "page_links"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        assert (sorted(got.columns), rows_of(got)) == duck_rows(own, catalogue.ORACLES[name])


def test_tables_with_spans_and_open_rows(spark):
    found = read(spark, "<table><tr><th rowspan='2'>A<th colspan=2>B<tr><td>c<td>d</table>", "<table><tr><td>1<table><tr><td>in</table></td><td rowspan=9>2</td></tr><tr><td>3</td></tr></table>", "<table><td>x</table><tr><td>stray</td></tr>")
    got = {(r["id"], r["table_node"], r["row"]): r["cells"] for r in markup.table_rows(found, "id").collect()}
    assert got[0, 0, 0] == ["A", "B", "B"] and got[0, 0, 1] == ["A", "c", "d"]
    assert got[1, 0, 0] == ["1 in", "2"] and got[1, 0, 1] == ["3", "2"] and [v for k, v in got.items() if k[0] == 1 and k[1] > 0] == [["in"]]
    assert len(got) == 5 or (2, 0, 0) not in got


@pytest.mark.parametrize("href, want", [
    ("http://x.y/z", "http://x.y/z"), ("/a", "https://h.org/a"), ("a?b", "https://h.org/p/a?b"), ("//c.d/e", "https://c.d/e"), ("#top", "https://h.org/p/q.html#top"), ("?n=2", "https://h.org/p/q.html?n=2"), ("mailto:a@b.org", "mailto:a@b.org"),
])
def test_addresses(spark, href, want):
    assert spark.range(1).select(markup.absolute(F.lit("https://h.org/p/q.html?x=1#y"), F.lit(href))).first()[0] == want


def test_links_are_made_whole(spark):
    found = read(spark, "<a title=t href='b'>x <i>y</i></a><a name=n>no</a><a href=''>no</a><A HREF = \"/c\">z</A>")
    base = spark.createDataFrame([(0, "http://h.org")], "id int, url string")
    assert [(r["text"], r["href"]) for r in markup.links(found, "id", base).orderBy("node").collect()] == [("x y", "http://h.org/b"), ("z", "http://h.org/c")]


LAWS = """<p>12 itens encontrados</p><table>
<tr class='topo'><td>Portaria nº 432   2025<td>Fulana<td>Nomeia &quot;alguém&quot;<td>x
<tr><td colspan=4><a class="btn cliqueaqui" href='/pdf/432.pdf'>Portaria 3 de maio.pdf</a><a class='cliqueaqui' href='no'>no</a>
<tr><td>Lei n° 7 2024<td><td>Altera<tr><td>sem arquivo</table>"""


def test_law_listing_and_its_pages(spark):
    found = read(spark, LAWS)
    got = sorted(tuple(r)[1:] for r in markup.law_rows(found, "id").collect())
    assert got == [("Lei", "7", 2024, "", "Altera", None, None), ("Portaria", "432", 2025, "Fulana", 'Nomeia "alguém"', "/pdf/432.pdf", "Portaria 3 de maio.pdf")]
    pages = lambda t: spark.range(1).select(markup.page_numbers(F.lit(t), 5)).first()[0]
    assert pages("foram 12 itens encontrados") == [1, 2, 3] and pages("0 itens encontrados") == [] and pages("nada") == []


COUNCIL = """<div class='contenedor_resultado_busca'><div class="titulo_item"><a href="?C_ORG=P">Projeto de Lei nº 12/2023</a></div><b>Exercício:</b> 2023 <b>Autor(es):</b> Ana &amp; Rui<br><b>Ementa:</b> Cria a feira
<b>Situação:</b> Aprovado<b>Localização:</b><a class=link_arquivo_item href='http://f/1.pdf'><span class=nome_arquivo_item>1.pdf</span></a></div>
<div class=contenedor_resultado_busca><a>Sem número</a></div><div class='contenedor_vereador x'><div class='nome_vereador' onClick="abre('INT_PES=77')">Bia  Reis</div><p>2021 a 2024 (ABC) e 2025 a 2028 ( DEF )</div>
<div class=contenedor_vereador><div class=nome_vereador>Sem id</div></div>"""


def test_council_pages(spark):
    found = read(spark, COUNCIL)
    (r,) = markup.projects(found, "id").collect()
    assert (r["kind"], r["number"], r["project_year"], r["year"], r["author"], r["summary"], r["status"], r["file"]) == ("Projeto de Lei", "12", 2023, "2023", "Ana & Rui", "Cria a feira", "Aprovado", "http://f/1.pdf")
    assert [tuple(x) for x in markup.members(found, "id").collect()] == [(0, 77, "Bia Reis")]
    assert spark.range(1).select(markup.terms(F.lit("2021 a 2024 (ABC) e 2025 a 2028 ( DEF )"))).first()[0] == [(2021, 2024, "ABC"), (2025, 2028, "DEF")]


def test_laws_are_listed_without_joins(spark):
    """A table of elements is small in files and large in memory, so none may be broadcast."""
    got = catalogue.QUERIES["law_listings"](spark, SF)
    got.collect()
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_law_rows_with_spans_nested_tables_and_several_links(spark):
    page = """<a class=cliqueaqui href='/out'>out</a><table><tr><td rowspan=2>Lei nº 1 2001<td>Ana<td>x<td>y<tr><td>Rui<td><div><a class='cliqueaqui' href='/2'>second</a><a class=cliqueaqui href='/3'>third</a></div>
<tr><td colspan=2>Decreto nº 2 2002<td>z<td>u<tr><td><table><tr><td>Portaria nº 3 2003<td>in<tr><td><a class=cliqueaqui href='/in'>inner</a></table><td><a href='/no'>no</a></table><table><td>Lei nº 4 2004</table>"""
    found = read(spark, page, None, "<table><tr><td>Lei nº 5 2005</table>")
    got = {(r["id"], r["kind"], r["number"], r["year"], r["author"], r["summary"], r["file"], r["file_name"]) for r in markup.law_rows(found, "id").collect()}
    assert got == {
        (0, "Lei", "1", 2001, "Ana", "x", "/2", "second"), (0, "Lei", "1", 2001, "Rui", "secondthird", None, None), (0, "Decreto", "2", 2002, "Decreto nº 2 2002", "z", "/in", "inner"),
        (0, "Portaria", "3", 2003, "in", "", "/in", "inner"), (2, "Lei", "5", 2005, "", "", None, None),
    }
