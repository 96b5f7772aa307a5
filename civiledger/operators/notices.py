"""What procurement records say in Portuguese: winners, items, results, earmarks, credits and cited laws.

Every rule is an ordered list of patterns over the text with its white space made single;
the first that finds something that survives its checks counts. All are columns, so
a text is read where it lies and nothing is shuffled but for a choice between rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import supplier_name
from ..functions.money import parse_money
from ..functions.text import digits, fold_lower

# How records are worded.
TAX_ID = r"([0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?\s?[0-9]{2})"
NUMBER_SIGN = r"(?:n[ºo°.]{0,2}\s*)?"
REGISTERED = rf"inscrit[oa]\s+no\s+CNPJ(?:\s+sob\s+o)?\s*{NUMBER_SIGN}:?\s*"
SUPPLIERS = (
    rf"(?is)empresa\s+contratada\s*:\s*([^,;]{{3,180}}?)\s*,?\s*{REGISTERED}{TAX_ID}",
    rf"(?is)raz[aã]o\s+social\s*:\s*([^,]{{3,180}}?)\s+logradouro\s*:.*?CNPJ\s*:\s*{TAX_ID}",
    rf"(?is)\be\s+a\s+empresa\s+([^,]{{3,180}}?)\s*,?\s*{REGISTERED}{TAX_ID}",
    rf"(?is)\be\s+a\s+empresa\s+([^,]{{3,180}}?)\s*,\s*com\s+sede.{{0,240}}?{REGISTERED}{TAX_ID}",
    rf"(?is)\be\s+a\s+empresa\s+([^,]{{3,180}}?)\s*[,-]?\s*CNPJ\s*{NUMBER_SIGN}:?\s*{TAX_ID}",
    rf"(?is)\ba\s+empresa\s+([^,]{{3,180}}?)\s*[,-]?\s*CNPJ\s*{NUMBER_SIGN}:?\s*{TAX_ID}",
    rf"(?is)\be\s+o\s+(cons[oó]rcio[^,]{{3,220}}?)\s*,[^.]{{0,260}}?{REGISTERED}{TAX_ID}",
    rf"(?is)\be\s+o\s+([^,]{{3,220}}?)\s*,\s*(?:com\s+endere[cç]o[^.]{{0,240}}?)?{REGISTERED}{TAX_ID}",
    rf"(?is)\b([A-ZÀ-Ü0-9][^,]{{3,180}}?)\s*,\s*{REGISTERED}{TAX_ID}",
)
#: What stands before a text's only foreign tax id.
BEFORE_ID = (
    r"(?is)(?:empresa|contratad[oa])\s*:?\s*([^.,;]{3,160})$",
    r"(?s)([A-ZÀ-Ü0-9][A-ZÀ-Ü0-9 .&'/-]{2,150}?[ -]+(?:LTDA\.?|EIRELI|EPP|MEI?|S/A|SA))\b[^,;]*$",
    r"(?is)([A-ZÀ-Ü0-9][^.,;]{3,160})$",
)
ID_WORDS = r"(?is)(?:\s*,\s*pessoa\s+jur[ií]dica[^,]*)*\s*,?\s*(?:inscrit[ao]\s+no\s+)?CNPJ(?:\s+sob\s+o)?\s*(?:n[ºo°.]?\s*)?:?\s*$"
#: Winners that are named without a tax id.
DECLARED = (
    r"(?is)(?:declarad[oa]\s+vencedor[a]?|vencedor[a]?\s+d[ao]\s+certame)\s+(?:a\s+empresa\s+|a\s+licitante\s+|o\s+licitante\s+)?([^,;.]{3,120}?)(?:\s+(?:no|com\s+o|pelo)\s+valor|[,;.]|$)",
    r"(?is)(?:adjudicad[oa]|homologad[oa])\s+(?:em\s+favor\s+d[ao]|[àa])\s+(?:empresa\s+)?([^,;.]{3,120}?)(?:\s+(?:no|com\s+o|pelo)\s+valor|[,;.]|$)",
    r"(?is)\bvencedor[a]?\s*:\s*([^,;.]{3,120}?)(?:\s+(?:no|com\s+o|pelo)\s+valor|\s+CNPJ|[,;.]|$)",
)
MONEY = r"R\$\s*([0-9.]+,[0-9]{2})"
VALUES = (
    rf"(?is)valor\s+do\s+contrato\s*:?\s*{MONEY}",
    rf"(?is)contrata[cç][aã]o\s+tem\s+valor\s+total\s+de\s*{MONEY}",
    rf"(?is)valor\s+total\s+(?:de|do\s+contrato\s+de)?\s*{MONEY}",
    rf"(?is)valor\s+global\s*(?:[:–-]|\s+de)?\s*{MONEY}",
    rf"(?is)pre[cç]o\s+global\s*(?:[:–-]|\s+de)?\s*{MONEY}",
    rf"(?is)\banual\s+de\s*{MONEY}",
    rf"(?is)os\s+valores\s+(?:para\s+execu[cç][aã]o[^.]{{0,120}}?|[^.]{{0,120}}?)\s+s[aã]o\s+de\s*{MONEY}",
)
#: How many of the patterns count in a mere notice.
IN_NOTICES = 2
PER_UNIT = r"(?is)\bpor\s+(?:ponto|unidade|km|m[eê]s|hora|item|servi[cç]o)(?:[^a-zà-ü]|$)"
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
CONTROLS = (rf"(?is)PNCP\s*:?\s*([0-9]{{14}}-[0-9]-[0-9]{{5,8}}/20[0-9]{{2}})", r"\b([0-9]{14}-[0-9]-[0-9]{5,8}/20[0-9]{2})\b")


def cased(pattern: str) -> str:
    """A pattern that takes accented letters of either case alike, too."""
    return pattern.replace("(?is)", "(?isu)").replace("(?i)", "(?iu)")


def extracted(c: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, cased(pattern), group)


def replaced(c: Column | str, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, cased(pattern), by)


def single_spaced(c: Column) -> Column:
    return F.trim(replaced(F.coalesce(c, F.lit("")), r"\s+", " "))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(options: list[Column]) -> Column:
    return F.coalesce(*options)


def let(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), of), 0)


def origin(text: Column, attachments: Column) -> Column:
    """What kind of record a text is: by its attachments' names, else by its own words."""
    names, folded = fold_lower(F.array_join(attachments, " ")), fold_lower(text)
    notice = folded.contains("edital de credenciamento") | folded.contains("edital do pregao")
    out = F.when(names.contains("contrat"), "contract").when(names.contains("ata"), "minutes").when(names.contains("homolog"), "approval").when(names.contains("extrato"), "extract")
    return out.when(notice, "notice").when(folded.contains("contrat"), "contract").when(folded.contains("ata"), "minutes").when(folded.rlike("homolog|adjudic|vencedor"), "approval").otherwise("notice")


def foreign_ids(text: Column, own: tuple[str, ...]) -> Column:
    """The distinct tax ids of a text, as digits, but for one's own."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TAX_ID), F.lit(1)), digits))
    return F.array_except(found, F.array(*map(F.lit, own)).cast("array<string>"))


def _supplier(text: Column, ids: Column, own: tuple[str, ...]) -> Column:
    """struct(winner, tax_id) or null."""
    options = []
    for p in SUPPLIERS:
        found = F.struct(let(extracted(text, p, 1), supplier_name).alias("winner"), digits(extracted(text, p, 2)).alias("tax_id"))
        options.append(let(found, lambda s: F.when((F.length(s["tax_id"]) == 14) & ~s["tax_id"].isin(*own) & s["winner"].isNotNull(), s)))
    # a single foreign id: its name is what stands before it
    sole = F.when(F.size(ids) == 1, ids[0])
    dotted = replaced(sole, "^(..)(...)(...)(....)(..)$", r"$1.$2.$3/$4-$5")

    def named(place: Column) -> Column:
        before = F.substring(text, F.greatest(place - 240, F.lit(1)), F.least(place - 1, F.lit(240)))
        before = F.trim(replaced(replaced(before, rf"(?i)\bCNPJ\s*:?\s*{TAX_ID}\s*", " "), ID_WORDS, ""))
        # the first form that is there decides, whether or not it is a name
        loose = lambda b: let(_first([_some(extracted(b, p, 1)) for p in BEFORE_ID]), supplier_name)
        return F.when(place > 0, let(before, loose))

    name = let(F.greatest(F.instr(text, dotted), F.instr(text, sole)), named)
    options.append(let(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("winner"), sole.alias("tax_id")))))
    for p in DECLARED:
        name = let(extracted(text, p, 1), supplier_name)
        options.append(let(name, lambda n: F.when(n.isNotNull(), F.struct(n.alias("winner"), F.lit(None).cast("string").alias("tax_id")))))
    return _first(options)


def _value(text: Column, kind: Column) -> Column:
    def of(pattern: str, in_notices: bool):
        def one(whole: Column) -> Column:
            after = F.substring(text, F.instr(text, whole) + F.length(whole), F.lit(180))
            good = (whole != "") & ~after.rlike(cased(PER_UNIT))
            value = F.when(good if in_notices else good & (kind != "notice"), parse_money(extracted(whole, pattern, 1)))
            return let(value, lambda v: F.when(v > 0, v))

        return one

    return _first([let(extracted(text, p, 0), of(p, i < IN_NOTICES)) for i, p in enumerate(VALUES)])


def spelled_date(c: Column) -> Column:
    """The first ``dd/mm/yyyy``, else the first ``d de month de yyyy`` of a text."""
    p = r"(?i)\b([0-9]{1,2})\s+de\s+([a-zç]+)\s+de\s+([0-9]{4})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), fold_lower(extracted(c, p, 2)))
    spelled = F.when(month > 0, F.concat(extracted(c, p, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(extracted(c, p, 1), 2, "0")))
    plain = extracted(c, r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b", 1)
    return F.when(plain != "", F.try_to_date(plain, "dd/MM/yyyy")).otherwise(F.try_to_date(spelled, "yyyy-MM-dd"))


def award_day(text: Column) -> Column:
    """The first date from 500 characters before to 1,200 after the first word of approval."""
    place = lambda folded: F.coalesce(*[F.nullif(F.instr(folded, w), F.lit(0)) for w in ("homolog", "adjudic")])

    def around(at: Column) -> Column:
        start = F.greatest(at - 500, F.lit(1))
        return F.when(at.isNotNull(), let(F.substring(text, start, at - start + 1200), spelled_date))

    return let(let(fold_lower(text), place), around)


def control(text: Column) -> Column:
    found = _first([_some(extracted(text, p, 1)) for p in CONTROLS])
    p = "^([0-9]{14})-([0-9])-([0-9]+)/([0-9]{4})$"
    part = lambda g: extracted(found, p, g)
    return F.when(found.isNotNull(), F.concat(part(1), F.lit("-"), part(2), F.lit("-"), F.when(F.length(part(3)) < 6, F.lpad(part(3), 6, "0")).otherwise(part(3)), F.lit("/"), part(4)))


def awards(docs: DataFrame, key: str, text: str, attachments: Column | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """key, winner, tax_id, value, day, control, origin, confidence of the texts that state any of them.

    Where several contracts are attached and several foreign ids occur, no single winner or value is taken.
    A notice's dates are not of an award.
    """
    files = F.coalesce(attachments, F.array().cast("array<string>")) if attachments is not None else F.array().cast("array<string>")

    def read(t: Column) -> Column:
        seen = F.struct(t.alias("t"), foreign_ids(t, own).alias("ids"), origin(t, files).alias("origin"))
        several = lambda r: (F.size(F.filter(files, lambda f: fold_lower(f).contains("contrato"))) > 1) & (F.size(r["ids"]) > 1)

        def found(r: Column) -> Column:
            supplier = F.when(~several(r), _supplier(r["t"], r["ids"], own))
            return F.struct(supplier.alias("s"), F.when(~several(r), _value(r["t"], r["origin"])).cast("double").alias("value"), F.when(r["origin"] != "notice", award_day(r["t"])).cast("string").alias("day"), control(r["t"]).alias("control"), r["origin"].alias("origin"))

        return let(seen, found)

    # bound to one array element, so what is filtered on is not computed again
    rows = docs.select(key, F.explode(F.array(let(single_spaced(F.col(text)), read))).alias("r"))
    out = rows.select(key, F.col("r.s.winner").alias("winner"), F.col("r.s.tax_id").alias("tax_id"), "r.value", "r.day", "r.control", "r.origin")
    count = reduce(Column.__add__, [F.col(n).isNotNull().cast("int") for n in ("winner", "tax_id", "value", "day", "control")])
    return out.withColumn("confidence", F.least(F.lit(0.95), F.round(F.lit(0.45) + 0.13 * count, 2))).filter(count > 0)


# Units of item tables, longer ones first.
UNITS = (
    r"(?:embalagem|pacote|pct|sach[eê]|caixa|unida\s?de|unida|pote|balde|lata|frasco|garrafa)(?:\s+(?:de|com))?\s+[0-9]+(?:[.,][0-9]+)?\s*(?:kg|gramas?|gr|g|ml)\.?|[0-9]+(?:[.,][0-9]+)?\s+gramas?"
    r"|unida\s?de|unid\.?|und\.?|kg|ma[cç]o|molho|pacote|caixa|lata|litro|fardo|pote|d[uú]zia|frasco|metro"
)
ITEM_HEAD = r"(?i)\bitem\s+uni\w*\.?\s+quant\w*\.?\s+especifica\S*o\b"
NUMERIC = r"[0-9]+(?:\.[0-9]{3})*(?:,[0-9]+)?"
UNIT_FIRST = rf"(?is)^({UNITS})\s+({NUMERIC})\s+(.+)$"
UNIT_INSIDE = rf"(?is)^(.+?)\s+({UNITS})\s+({NUMERIC})\s+(.+)$"


def _segments(region: Column, mark: str) -> Column:
    """What follows each mark, with the number in front."""
    return F.slice(F.split(replaced(region, mark, "\u0001$1\u0002"), "\u0001"), 2, 1 << 30)


def _number(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def table_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, unit, quantity, description of the item table of a text; unit and quantity may stand before or inside the description."""
    t = single_spaced(F.col(text))
    head = F.instr(t, extracted(t, ITEM_HEAD, 0))
    region = F.when(t.rlike(cased(ITEM_HEAD)), F.substring(t, head, F.length(t)))
    region = replaced(region, r"(?is)\b2\.\s+DA\s+JUSTIFICATIVA\b.*$", "")
    rows = docs.select(key, F.explode(_segments(region, r"(?:^|\s)([0-9]{1,4})\.\s+")).alias("s"))
    rows = rows.select(key, F.split_part("s", F.lit("\u0002"), F.lit(1)).cast("int").alias("item"), F.trim(F.split_part("s", F.lit("\u0002"), F.lit(2))).alias("body")).filter("item > 0")
    first, inside = (lambda g: extracted("body", UNIT_FIRST, g)), (lambda g: extracted("body", UNIT_INSIDE, g))
    is_first = first(1) != ""
    out = rows.select(
        key, "item", F.lower(F.when(is_first, first(1)).otherwise(inside(2))).alias("unit"), _number(F.when(is_first, first(2)).otherwise(inside(3))).alias("quantity"),
        F.trim(F.when(is_first, first(3)).otherwise(F.concat_ws(" ", inside(1), inside(4)))).alias("description"),
    )
    return out.filter((F.col("quantity") > 0) & (F.length("description") >= 3) & (F.col("unit") != ""))


# Sections and rows of minutes.
SECTION_ENDS = r"HABILITA\S*O|RECURSOS|OCORR\S*NCIAS|ENCERRAMENTO|ASSINAM"
NEGOTIATED = rf"(?is)^(.*?)\s*Fornecedor\s+Valor\s+Negociado\s+Valor\s+Vencedor\s+Situa\S*o\s+(.+?)\s+{MONEY}\s+{MONEY}\s+Vencedor"
RANKED = rf"(?is)^(.*?)\s*Fornecedor\s+Valor\s+Classifica\S*o\s+(.+?)\s+{MONEY}\s+1[^0-9a-z]{{0,8}}-?\s*Lugar"
PLATFORM_MARK = r"(?i)\b(?:Item|Lote)\s+([0-9]{1,4}\s*(?:[-–]\s*.{0,220}?)?)\s+Status:\s*"
PLATFORM_ROW = r"(?is)1\s*[°º]\s+([A-ZÀ-Ú0-9][A-ZÀ-Ú0-9 .&'/-]{3,180}?)\s+([0-9]{11,14})\s+(?:R\$\s*)?([0-9.]+,[0-9]{2,4})\s+Vencedor"


def _section(t: Column, head: str, ends: str) -> Column:
    """From the first heading to the next end, null without the heading."""
    found = extracted(t, rf"\b({head})\b", 1)
    rest = F.substring(t, F.instr(t, found) + F.length(found), F.length(t))
    return F.when(found != "", replaced(rest, rf"(?s)\b(?:{ends})\b.*$", ""))


def item_results(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, item, layout, description, supplier, value, confidence of the results of items that minutes state.

    The layout of electronic platforms counts alone where it gives any row. Else an
    item's first result counts, in the order negotiated, ranked, declared, labelled.
    """
    t = single_spaced(F.col(text))
    none = F.array().cast("array<struct<rank:int,layout:string,confidence:double,item:int,description:string,supplier:string,value:double>>")
    value = lambda c: _number(F.replace(c, F.lit("R$"), F.lit(""))).cast("double")

    def rows_of(region: Column, mark: str, rank: int, layout: str, sure: float, fields) -> Column:
        def one(s: Column) -> Column:
            item, body = extracted(s, "^([0-9]+)", 1).cast("int"), F.trim(F.split_part(s, F.lit("\u0002"), F.lit(2)))
            description, supplier, amount = fields(F.split_part(s, F.lit("\u0002"), F.lit(1)), body)
            return F.struct(F.lit(rank).alias("rank"), F.lit(layout).alias("layout"), F.lit(sure).alias("confidence"), item.alias("item"), F.trim(description).alias("description"), supplier_name(supplier).alias("supplier"), value(amount).alias("value"))

        found = F.filter(F.transform(_segments(region, mark), one), lambda r: r["supplier"].isNotNull() & (r["value"] > 0) & (F.length(r["description"]) > 0))
        return F.coalesce(found, none)

    extract = lambda p, g: (lambda _, body: extracted(body, p, g))
    three = lambda p, a, b, c: (lambda head, body: (extract(p, a)(head, body), extract(p, b)(head, body), extract(p, c)(head, body)))

    def platform(head: Column, body: Column):
        title = extracted(head, r"^[0-9]+\s*[-–]\s*(.+)$", 1)
        said = extracted(body, r"(?is)Descri\S*o\s+complementar:\s*(.{2,700}?)(?:\s+Quantidade:|\s+Estimado:|\s+Unidade\s+de\s+medida:)", 1)
        good = fold_lower(body).startswith("aprovado")
        return F.when(title != "", title).otherwise(said), F.when(good, extracted(body, PLATFORM_ROW, 1)).otherwise(""), extracted(body, PLATFORM_ROW, 3)

    def declared(_: Column, body: Column):
        before = extracted(body, rf"(?is)^(.*?){MONEY}", 1)
        parts = F.filter(F.transform(F.split(before, r"\s*[|.]\s*"), lambda p: F.trim(p)), lambda p: p != "")
        good = body.rlike(cased(r"(?i)\b[VN]ence\w*"))
        return F.get(parts, 0), F.when(good, F.array_join(F.slice(parts, 2, 99), " ")).otherwise(""), extracted(body, MONEY, 1)

    def labelled(_: Column, body: Column):
        return F.lit("-"), extracted(body, r"(?is)^vencedor[a]?\s*:\s*([^,;|]{3,120}?)\s*(?:[,;|-]|\s+no\s+valor|\s+valor|CNPJ)", 1), extracted(body, MONEY, 1)

    dotted, dashed = r"(?:^|\s)([0-9]{1,4})\.\s+", r"\b([0-9]{1,4})\s*[-–]\s+"
    marked = docs.select(
        key, rows_of(t, PLATFORM_MARK, 0, "platform", 0.9, platform).alias("platform"),
        F.concat(
            rows_of(_section(t, r"NEGOCIA\S*O", SECTION_ENDS), dotted, 1, "negotiated", 0.92, three(NEGOTIATED, 1, 2, 4)),
            rows_of(_section(t, r"CLASSIFICA\S*O", r"NEGOCIA\S*O|" + SECTION_ENDS), dotted, 2, "ranked", 0.88, three(RANKED, 1, 2, 3)),
            rows_of(_section(t, "RESULTADO", r"ENCERRAMENTO|ASSINAM|RECURSOS|OCORR\S*NCIAS"), dashed, 3, "declared", 0.86, declared),
            rows_of(t, r"(?i)\bitem\s+([0-9]{1,4})\s*[-–:]\s*", 4, "labelled", 0.8, labelled),
        ).alias("others"),
    )
    each = marked.select(key, F.explode(F.when(F.size("platform") > 0, F.col("platform")).otherwise(F.col("others"))).alias("r"))
    best = F.struct(F.col("r.rank"), F.col("r.layout"), F.col("r.confidence"), F.col("r.description"), F.col("r.supplier"), F.col("r.value"))
    return each.groupBy(key, F.col("r.item").alias("item")).agg(F.min(best).alias("b")).select(key, "item", "b.layout", "b.description", "b.supplier", "b.value", "b.confidence")


# Labels of the earmark form, and what tells its sphere.
LABELS = (
    "N.o DA EMENDA", "No DA EMENDA", "Nº DA EMENDA", "N.º DA EMENDA", "NOME DO PARLAMENTAR", "PARTIDO DO PARLAMENTAR", "UNIDADE PARLAMENTAR", "TIPO DE TRANSFERÊNCIA", "TIPO DE TRANSFERENCIA",
    "TIPO DE EMENDA", "OBJETO DETALHADO", "OBJETO", "VALOR DO REPASSE", "VALOR DA CONTRAPARTIDA", "ÓRGÃO TRANSFERIDOR", "ORGAO TRANSFERIDOR", "INSTRUMENTO LEGAL", "CATEGORIA ECONÔMICA",
    "CATEGORIA ECONOMICA", "UNIDADE EXECUTORA", "GESTOR RESPONSÁVEL", "GESTOR RESPONSAVEL", "CONTA BANCÁRIA", "CONTA BANCARIA", "AGÊNCIA", "AGENCIA", "BANCO", "DATA DE RECEBIMENTO DO RECURSO",
    "DADOS DA DESPESA", "INÍCIO", "INICIO", "TÉRMINO", "TERMINO",
)
SPHERES = (("state", r"(?i)emendas?\s+estadua(?:l|is)"), ("federal", r"(?i)emendas?\s+federa(?:l|is)"), ("state", r"(?i)assembleia\s+legislativa"), ("federal", r"(?i)c[aâ]mara\s+dos\s+deputados|senado\s+federal"))
EARMARK = r"(?i)emendas?\s+(?:estadua(?:l|is)|federa(?:l|is)|parlamentar)"


def form_field(text: Column, *labels: str) -> Column:
    """What stands behind the first of these labels that is there, up to the next known label or numbered section, of 800 characters at most."""
    words = "|".join(x.replace(".", r"\.") for x in sorted(LABELS, key=len, reverse=True))
    options = []
    for label in labels:
        rest = extracted(text, rf"(?is){label.replace('.', '[.]')}\s*:\s*(.{{0,800}})", 1)
        cut = replaced(rest, rf"(?is)\s*(?:(?:^|\s)(?:{words})\s*:|\s[0-9]{{1,2}}\s*[–—-]\s*[A-ZÀ-Ü]).*$", "")
        options.append(_some(F.trim(cut)))
    return _first(options)


def earmarks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, legislator, role, party, sphere, kind, object, detail, value, own_value, received, starts, year of the forms that are of an earmark."""
    rows = docs.select(key, replaced(F.coalesce(F.col(text), F.lit("")), r"\s+", " ").alias("t")).filter((F.length("t") >= 50) & F.col("t").rlike(cased(EARMARK)))
    t = F.col("t")
    who = form_field(t, "NOME DO PARLAMENTAR")
    part = lambda g: F.trim(extracted(who, r"^(.+?)\s*[-–—]\s*(.+)$", g))
    sphere = reduce(lambda w, s: w.when(t.rlike(cased(s[1])), s[0]), SPHERES, F)
    amount = lambda label: _number(extracted(form_field(t, label), r"R\$\s*([0-9.,]*[0-9])", 1))
    day = lambda *labels: F.try_to_date(extracted(form_field(t, *labels), "([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy")
    number = form_field(t, "N.o DA EMENDA", "No DA EMENDA", "Nº DA EMENDA", "N.º DA EMENDA")
    got = rows.select(
        key, number.alias("number"), F.when(part(1) != "", part(1)).otherwise(who).alias("legislator"), _some(part(2)).alias("role"), form_field(t, "PARTIDO DO PARLAMENTAR").alias("party"), sphere.alias("sphere"),
        form_field(t, "TIPO DE EMENDA").alias("kind"), form_field(t, "OBJETO").alias("object"), form_field(t, "OBJETO DETALHADO").alias("detail"), amount("VALOR DO REPASSE").alias("value"),
        amount("VALOR DA CONTRAPARTIDA").alias("own_value"), day("DATA DE RECEBIMENTO DO RECURSO").alias("received"), day("INICIO", "INÍCIO").alias("starts"),
    )
    federal = extracted(digits(F.col("number")), "^(20[0-9]{2})[0-9]{8}$", 1)
    state = extracted("number", r"/\s*(20[0-9]{2})\b", 1)
    year = F.coalesce(F.year("received"), F.when(F.col("number").rlike(cased(r"^\s*[0-9][0-9\s.]*$")), _some(federal)).cast("int"), _some(state).cast("int"), F.year("starts"))
    return got.withColumn("year", year).withColumns({c: F.col(c).cast("string") for c in ("received", "starts")})


# How scanned decrees open credits.
CREDIT_TOTAL = r"(?is)Cr[ée]dito\s*Suplementar\s*no\s*valor\s*total\s*de\s*R\s*[$S§5]?\s*([0-9. ]+,\s?[0-9]{2})"
CREDIT_SOURCES = (("annulment", r"(?i)anulad|anula[cç]|anr\S{0,3}a[cç]"), ("surplus", r"(?i)super[aá]vit"), ("excess", r"(?i)excesso\s+de\s+a"))


def credits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, day, total, source: decrees that open a credit, read as scanning leaves them; the source is told in the 600 characters from where means are named."""
    t = single_spaced(F.col(text))
    means = extracted(t, r"(?is)(como\s+recursos.{0,588})", 1)
    named = F.array_compact(F.array(*[F.when(means.rlike(cased(p)), F.lit(n)) for n, p in CREDIT_SOURCES]))
    total = F.replace(replaced(extracted(t, CREDIT_TOTAL, 1), r"[\s.]", ""), F.lit(","), F.lit(".")).try_cast("decimal(18,2)").cast("double")
    out = docs.select(
        key, _some(extracted(t, r"(?i)decreto\s+n[º°o]?\s*([0-9][0-9./-]*)", 1)).alias("number"), spelled_date(extracted(t, r"(?i)((?:de|em)\s+[0-9]{1,2}\s+de\s+\S+\s+de\s+[0-9]{4})", 1)).cast("string").alias("day"),
        total.alias("total"), F.when(F.size(named) > 1, "mixed").otherwise(F.get(named, 0)).alias("source"),
    )
    return out.filter("number IS NOT NULL OR total IS NOT NULL")


# Fixed value: how a municipal law is cited.
LAW = r"(?i)\bLei\s+(?:Municipal\s+|Ordin[aá]ria\s+(?:Municipal\s+)?)?(?:n[ºo°.]{0,2}\s*)?([0-9]{1,2}[. ]?[0-9]{3})\s*(?:,\s*de\s+[^,.;]{3,25}?\s+de\s+([0-9]{4})|/\s*([0-9]{4}))"


def law_citations(docs: DataFrame, key: str, text: str, own: Column, least_number: int = 1, least_year: int = 0) -> DataFrame:
    """key, number, year of the laws that a text cites, once each, but for the law that it is itself (``own``)."""
    t = single_spaced(F.col(text))
    found = [F.regexp_extract_all(t, F.lit(cased(LAW)), F.lit(g)) for g in (1, 2, 3)]
    each = docs.select(key, own.alias("_own"), F.explode(F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("n", "a", "b"), strict=True)])).alias("c"))
    year = F.when(F.col("c.a") != "", F.col("c.a")).otherwise(F.col("c.b")).cast("int")
    rows = each.select(key, "_own", digits(F.col("c.n")).cast("int").alias("number"), year.alias("year"))
    return rows.filter(~F.col("number").eqNullSafe(F.col("_own")) & (F.col("number") >= least_number) & (F.col("year") >= least_year)).select(key, "number", "year").distinct()


def absent_laws(docs: DataFrame, key: str, text: str, own: Column, laws: DataFrame, least_number: int = 1000, least_year: int = 2010) -> DataFrame:
    """number, year, n_citing of cited laws within the corpus' numbers that it (``laws``: number) does not hold."""
    cited = law_citations(docs, key, text, own, least_number, least_year)
    top = laws.agg(F.max("number").alias("top"))
    inside = cited.join(F.broadcast(top), F.col("number") <= F.col("top")).drop("top")  # one row
    return inside.join(laws.select("number").distinct(), "number", "left_anti").groupBy("number", "year").agg(F.countDistinct(key).alias("n_citing"))
