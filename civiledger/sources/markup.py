"""Pages as tables of elements: a tag-stack reader inside tasks, and scans built on it with DataFrames.

The reader goes through a page once and keeps the stack of open elements: quotes of either
kind or none, entities, comments, raw text of scripts, elements that need no end and ends that
are left out. Each element asked for becomes a row with its place, its ancestors, its
attributes, its text, and, in tables, its row and column with spans taken into account.
Lists, tables, links, listings and records are then filters and groupings of such rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements without content, and what an opening tag ends by being there (up to the nearest of the second set).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "thead": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
    **{t: ({"p"}, {"td", "th", "div", "article", "section", "body", "li", "button", "table"}) for t in "p div ul ol table h1 h2 h3 h4 h5 h6 article section footer nav header form hr pre".split()},
}
APART = frozenset("p div li tr td th table ul ol h1 h2 h3 h4 h5 h6 br option dt dd title article section footer nav header".split())
UNSEEN = frozenset(("script", "style", "template"))
#: An ampersand, and the reference that it begins, if that ends in a semicolon.
REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([a-zA-Z][a-zA-Z0-9]*;))?")
FIELDS = "node int, parent int, tag string, attributes map<string,string>, classes array<string>, ancestors array<int>, tags_above array<string>, text string, own_text string, table_node int, row int, col int, rows int, cols int"


class _Open:
    __slots__ = ("node", "tag", "attributes", "start", "own", "ancestors", "above", "table", "row", "col", "rows", "cols", "taken", "at_row")

    def __init__(self, node: int, tag: str, attributes: dict, start: int):
        self.node, self.tag, self.attributes, self.start, self.own = node, tag, attributes, start, []
        self.table = self.row = self.col = None
        self.rows = self.cols = 1
        self.taken: dict[tuple[int, int], bool] = {}
        self.at_row = -1


def _ended(page: str) -> str:
    """The page with every ampersand that begins no reference ended by a semicolon standing for itself."""
    return REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], page)


class Reader(HTMLParser):
    """Reads one page; ``done`` holds the elements with one of the tags (all, if none are named), in the order of their beginnings.

    HTML also reads some references without their semicolon; ``ended`` leaves those as they are written.
    """

    def __init__(self, tags: frozenset[str], ended: bool = False):
        super().__init__(convert_charrefs=True)
        self.ended = ended
        self.tags, self.stack, self.done, self.text, self.length, self.count = tags, [], [], [], 0, 0

    def _say(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)

    def handle_starttag(self, tag, attrs):
        what, within = ENDS.get(tag, ((), ()))
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag in within:
                break
            if self.stack[at].tag in what:
                self._close(at)
        if tag in APART:
            self._say(" ")
        e = _Open(self.count, tag, {k: v or "" for k, v in reversed(attrs)}, self.length)
        self.count += 1
        e.ancestors, e.above = [o.node for o in self.stack], [o.tag for o in self.stack]
        if tag in ("tr", "td", "th"):
            self._place(e)
        self.stack.append(e)
        if tag in VOID:
            self._close(len(self.stack) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends only elements without content

    def _place(self, e: _Open) -> None:
        table = next((o for o in reversed(self.stack) if o.tag == "table"), None)
        if table is None:
            return
        e.table = table.node
        if e.tag == "tr":
            table.at_row += 1
            e.row = table.at_row
            return
        span = lambda name: min(max(int(v), 1), 1000) if (v := e.attributes.get(name, "").strip()).isdecimal() else 1
        e.row, e.rows, e.cols, col = max(table.at_row, 0), span("rowspan"), span("colspan"), 0
        while (e.row, col) in table.taken:
            col += 1
        e.col = col
        for r in range(e.row, e.row + e.rows):
            for c in range(col, col + e.cols):
                table.taken[r, c] = True

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                self._close(at)
                break
            if self.stack[at].tag == "table" and tag not in ("body", "html"):
                break  # an end inside a table ends nothing outside

    def handle_data(self, data):
        if not any(o.tag in UNSEEN for o in self.stack[-1:]):
            self._say(data)
            if self.stack:
                self.stack[-1].own.append(data)

    def _close(self, at: int) -> None:
        for e in reversed(self.stack[at:]):
            if not self.tags or e.tag in self.tags:
                self.done.append((e, self.length))
            if e.tag in APART:
                self._say(" ")
        del self.stack[at:]

    def read(self, page: str | None) -> list[tuple]:
        if page:
            self.feed(_ended(page) if self.ended else page)
            self.close()
            self._close(0)
        whole = "".join(self.text)
        single = lambda s: " ".join(s.split())
        out = []
        for e, end in sorted(self.done, key=lambda x: x[0].node):
            out.append((e.node, e.ancestors[-1] if e.ancestors else None, e.tag, list(e.attributes.items()), e.attributes.get("class", "").split(), e.ancestors, e.above, single(whole[e.start : end]), single(" ".join(e.own)), e.table, e.row, e.col, e.rows, e.cols))
        return out


def elements(pages: DataFrame, key: str, html: str, tags: tuple[str, ...] = (), ended: bool = False) -> DataFrame:
    """One row an element of these tags (of all, if none are named): the key and ``FIELDS``. A null or empty page has none.

    With ``ended``, only references that end in a semicolon are read.
    """
    wanted = frozenset(tags)
    rows = pages.select(F.col(key), F.col(html))
    kinds = [
        pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), *[pa.int32()] * 5,
    ]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def packed(held: list[tuple], keys: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], [key, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, keys, size, kind = [], [], 0, batch.schema.types[0]
            for i in range(batch.num_rows):  # a few pages at a time bound what is held
                page = batch.column(1)[i].as_py()
                found = Reader(wanted, ended).read(page)
                held += found
                keys += [batch.column(0)[i].as_py()] * len(found)
                size += len(page or "")
                if held and (len(held) >= 4096 or size >= 4 << 20):
                    yield packed(held, keys, kind)
                    held, keys, size = [], [], 0
            if held:
                yield packed(held, keys, kind)

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {FIELDS}")


def absolute(base: Column, address: Column) -> Column:
    """An address as seen from a page: whole ones stay, those from the root or of the same protocol take the page's, others its folder."""
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/.*/)?)", 1)
    a = F.trim(address)
    relative = F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), a)
    return F.when(a.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), a).when(a.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z0-9+.-]+:)", 1), a)).when(a.startswith("/"), F.concat(root, a)).when(a == "", base).when(a.startswith("#") | a.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), a)).otherwise(relative)


def inside(found: DataFrame, key: str, outer: Column, *of: str) -> DataFrame:
    """Each element with the innermost of its ancestors that is among ``outer`` elements of the page, as ``item``, and that one's columns ``of``."""
    items = found.filter(outer).select(F.col(key).alias("_key"), F.col("node").alias("item"), *[F.col(c).alias(f"item_{c}") for c in of])
    each = found.withColumn("_up", F.explode("ancestors"))
    joined = each.join(items, (F.col(key) == F.col("_key")) & (F.col("_up") == F.col("item"))).drop("_key", "_up")
    nearest = F.row_number().over(Window.partitionBy(key, "node").orderBy(F.desc("item")))
    return joined.withColumn("_n", nearest).filter("_n = 1").drop("_n")


def table_rows(found: DataFrame, key: str) -> DataFrame:
    """key, table_node, row, cells: the texts of each row of a table by column; a cell that spans stands in all its places."""
    cells = found.filter("tag IN ('td', 'th') AND table_node IS NOT NULL")
    last = found.filter("tag = 'tr' AND table_node IS NOT NULL").groupBy(key, "table_node").agg(F.max("row").alias("last"))
    places = cells.join(last, [key, "table_node"]).withColumn("row", F.explode(F.sequence("row", F.greatest("row", F.least("last", F.col("row") + F.col("rows") - 1)))))
    places = places.withColumn("col", F.explode(F.sequence("col", F.col("col") + F.col("cols") - 1)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("col", "node", "text"))), lambda c: c["text"])
    return places.groupBy(key, "table_node", "row").agg(texts.alias("cells"))


def list_items(found: DataFrame, key: str) -> DataFrame:
    """key, node, depth, text of list items: their own words and those of elements inside that are no lists."""
    is_list = lambda t: t.isin("ul", "ol", "menu")
    return found.filter("tag = 'li'").select(key, "node", F.size(F.filter("tags_above", is_list)).alias("depth"), "text", "own_text")


def links(found: DataFrame, key: str, base: DataFrame | None = None, address: str = "url") -> DataFrame:
    """key, node, text, href of links with an address, made whole where the pages' own are given (``base``: key, ``address``)."""
    rows = found.filter("tag = 'a'").select(key, "node", "text", F.trim(F.try_element_at("attributes", F.lit("href"))).alias("href")).filter("href <> ''")
    return rows if base is None else rows.join(base.select(key, F.col(address).alias("_base")), key, "left").withColumn("href", F.coalesce(absolute(F.col("_base"), F.col("href")), "href")).drop("_base")


def page_numbers(text: Column, size: int) -> Column:
    """The pages of a listing that says how many items were found; empty where it does not say or there are none."""
    n = F.regexp_extract(text, r"(?i)([0-9]{1,9})\s+itens\s+encontrados", 1).try_cast("int")
    return F.when(n > 0, F.sequence(F.lit(1), F.ceil(n / size).cast("int"))).otherwise(F.array().cast("array<int>"))


# How listings word their records.
LAW_ROW = r"(?i)^(.+?)\s+n[ºo°]\s*([0-9]+)\s+([0-9]{4})$"
PROJECT_TITLE = r"(?i)^(.+?)\s+n[ºo°.]*\s*([0-9]+)\s*/\s*([0-9]{4})"
PROJECT_LABELS = {"year": r"Exerc[íi]cio", "author": r"Autor\(es\)", "summary": "Ementa", "status": r"Situa[çc][ãa]o", "place": r"Localiza[çc][ãa]o"}


def law_rows(found: DataFrame, key: str) -> DataFrame:
    """key, kind, number, year, author, summary, file, file_name: a row of four cells says what a law is, the next row links its file.

    Elements are dealt by page once and only grouped after that: nothing is joined, so nothing is sent around whole.
    """
    w = Window.partitionBy(key, "table_node")
    is_row, is_cell = (F.col("tag") == "tr") & F.col("table_node").isNotNull(), F.col("tag").isin("td", "th") & F.col("table_node").isNotNull()
    is_link = (F.col("tag") == "a") & F.array_contains("classes", "cliqueaqui")
    cell = F.when(is_cell, F.struct("col", "cols", "rows", "node", "text")).alias("cell")
    link = F.struct(F.col("node"), F.try_element_at("attributes", F.lit("href")).alias("href"), "text")
    own = F.struct(F.col("node").alias("at"), "table_node", "row", is_row.alias("is_row"), cell, F.when(is_link, link).alias("link"))
    # a link says itself to all that it stands in
    said = F.when(is_link, F.transform("ancestors", lambda t: F.struct(t.alias("at"), F.lit(None).cast("int").alias("table_node"), F.lit(None).cast("int").alias("row"), F.lit(False).alias("is_row"), F.when(F.lit(False), F.struct("col", "cols", "rows", "node", "text")).alias("cell"), link.alias("link")))).otherwise(F.array(own))
    each = found.filter(is_row | is_cell | is_link).select(key, F.explode(said).alias("s")).select(key, "s.*").repartition(key)
    nodes = each.groupBy(key, "at").agg(F.max("table_node").alias("table_node"), F.max("row").alias("row"), F.max("is_row").alias("is_row"), F.max("cell").alias("cell"), F.min("link").alias("link")).filter("table_node IS NOT NULL")
    nodes = nodes.withColumn("last", F.max(F.when(F.col("is_row"), F.col("row"))).over(w))
    until = F.greatest("row", F.least("last", F.col("row") + F.coalesce("cell.rows", F.lit(1)) - 1))
    places = F.transform(F.sequence("cell.col", F.col("cell.col") + F.col("cell.cols") - 1), lambda c: F.struct(c.alias("col"), F.col("cell.node").alias("node"), F.col("cell.text").alias("text")))
    nodes = nodes.select(key, "table_node", F.explode(F.sequence("row", until)).alias("row"), "is_row", places.alias("places"), F.when(F.col("is_row"), F.col("link")).alias("link"))
    texts = F.transform(F.array_sort(F.flatten(F.collect_list("places"))), lambda c: c["text"])
    rows = nodes.groupBy(key, "table_node", "row").agg(F.max("is_row").alias("is_row"), F.min("link").alias("link"), texts.alias("cells")).filter("is_row")
    both = rows.withColumn("next", F.lead("link").over(w.orderBy("row")))
    part = lambda g: F.regexp_extract(F.get("cells", 0), LAW_ROW, g)
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return both.filter(part(1) != "").select(key, part(1).alias("kind"), part(2).alias("number"), part(3).cast("int").alias("year"), cell(1).alias("author"), cell(2).alias("summary"), F.col("next.href").alias("file"), F.col("next.text").alias("file_name"))


def projects(found: DataFrame, key: str, box: str = "contenedor_resultado_busca") -> DataFrame:
    """key, item, kind, number, project_year and the labelled fields, file of each result box of a council's search."""
    held = inside(found, key, F.array_contains("classes", box), "text")
    title = held.filter((F.col("tag") == "a") & F.exists(F.col("tags_above"), lambda t: t.isNotNull()))
    first = title.groupBy(key, "item", "item_text").agg(
        F.min_by("text", "node").alias("title"), F.min_by(F.try_element_at("attributes", F.lit("href")), F.when(F.array_contains("classes", "link_arquivo_item"), F.col("node"))).alias("file"),
    )
    part = lambda g: F.regexp_extract("title", PROJECT_TITLE, g)
    ahead = "|".join(PROJECT_LABELS.values())
    field = lambda p: F.nullif(F.trim(F.regexp_extract("item_text", rf"{p}:\s*(.*?)\s*(?:(?:{ahead}):|$)", 1)), F.lit(""))
    return first.filter(part(1) != "").select(key, "item", part(1).alias("kind"), part(2).alias("number"), part(3).cast("int").alias("project_year"), *[field(p).alias(n) for n, p in PROJECT_LABELS.items()], "file")


def members(found: DataFrame, key: str, box: str = "contenedor_vereador") -> DataFrame:
    """key, member_id, name of each member's box: the name's element holds the id in what it does on a click."""
    named = inside(found, key, F.array_contains("classes", box)).filter(F.array_contains("classes", "nome_vereador"))
    number = F.regexp_extract(F.coalesce(F.try_element_at("attributes", F.lit("onclick")), F.lit("")), "INT_PES=([0-9]+)", 1)
    return named.select(key, number.try_cast("int").alias("member_id"), F.col("text").alias("name")).filter("member_id IS NOT NULL AND name <> ''")


def terms(text: Column) -> Column:
    """Array of (first, last, party) of ``2021 a 2024 (ABC)``."""
    p = r"([0-9]{4})\s+a\s+([0-9]{4})\s*\(([^)]+)\)"
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[f.alias(n) for f, n in zip(found, "abc", strict=True)])
    return F.transform(zipped, lambda t: F.struct(t["a"].cast("int").alias("first"), t["b"].cast("int").alias("last"), F.trim(t["c"]).alias("party")))
