"""Records out of reports, pages, feeds and texts, as columns and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import amounts, parse_money
from ..functions.text import fold_lower


def some(c: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern finds, null for nothing."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


LEDGER_CSV = "number string, payee string, kind string, process string, source string, committed_on string, settled_on string, paid_on string, committed string, settled string, paid string, rest string"


def ledger_lines(lines: DataFrame, line: str) -> DataFrame:
    """Entries of a ledger report: rows without a commitment number are fillers, payment orders reuse others' numbers; both are left out."""
    c = lines.select(F.from_csv(F.col(line), LEDGER_CSV, {"quote": '"'}).alias("c")).select("c.*")
    part = lambda g: F.regexp_extract("number", r"^\s*([0-9]{5}-[0-9]{3}) / ([0-9]{4})\s*$", g)
    money = lambda n: parse_money(F.trim(F.col(n)))
    rows = c.filter((part(1) != "") & ~F.coalesce("kind", F.lit("")).ilike("OP%"))
    return rows.select(
        part(1).alias("number"), part(2).cast("int").alias("fiscal_year"), some(F.col("payee"), r"^\s*([0-9]+) - ").alias("payee_code"), some(F.col("payee"), r"^\s*[0-9]+ - (.+?)\s*$").alias("payee_name"),
        F.try_to_date("committed_on", "dd/MM/yyyy").alias("committed_on"), F.coalesce(money("committed"), money("paid"), F.lit(0).cast("decimal(18,2)")).alias("value"),
    )


#: Lines that one task numbers at a time.
CHUNK = 50_000


def running_sum(rows: DataFrame, file: str, number: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of ``value`` over a file's lines up to each, itself included.

    Files are summed up in chunks of lines, and each chunk begins with what those before it
    hold, so only sums of chunks, not lines, of a file meet in a task.
    """
    cut = rows.withColumns({"_chunk": F.floor(F.col(number) / chunk), "_v": value.cast("bigint")})
    w = Window.partitionBy(file).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(file, "_chunk").agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inner = Window.partitionBy(file, "_chunk").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_in", F.sum("_v").over(inner)).join(sums, [file, "_chunk"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_chunk", "_v", "_in", "_before")


def logical_lines(lines: DataFrame, file: str, number: str, line: str, chunk: int = CHUNK) -> DataFrame:
    """Lines of a file put together while a quotation is open: a line belongs to the last one that began with an even count of quotes."""
    quotes = F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))
    rows = running_sum(lines, file, number, quotes, "_quotes", chunk)
    opens = ((F.col("_quotes") - quotes) % 2 == 0).cast("int")
    rows = running_sum(rows, file, number, opens, "_at", chunk)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, line))), lambda x: x[line]), "\n")
    return rows.groupBy(file, F.col("_at").alias(number)).agg(joined.alias(line))


PAYROLL = "bond string, registration string, year int, month int, name string, masked_id string, status string, admission string, job string, function string, department string, assignment string, job_code string, admitted_on string, hours string, base_salary double, gross double, net double, rubrics array<struct<code:string,description:string,reference:string,earnings:double,deductions:double>>"


def plain_number(c: Column) -> Column:
    """``1.234,56``, ``1234.56`` or ``1234`` as a double; null for anything else."""
    c = F.trim(c)
    return F.when(c.rlike(r"^[0-9.]*,[0-9]+$"), F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(c).try_cast("double")


def payroll_records(lines: DataFrame, file: str, number: str, line: str, chunk: int = CHUNK) -> DataFrame:
    """file and ``PAYROLL``: the records of a payroll report of quoted fields.

    A record runs from its bond to the next one; what is read of it is its labelled
    fields, the rubrics behind their heading, and its gross and net pay from the footer,
    a field of several lines. A record without a footer is left out.
    """
    rows = logical_lines(lines, file, number, line, chunk)
    cells = F.transform(F.split(F.regexp_replace(line, r'(?s)^\s*"|"\s*$', ""), '","'), lambda c: F.trim(F.replace(c, F.lit('""'), F.lit('"'))))
    rows = rows.select(file, number, cells.alias("c"))
    start = F.coalesce(F.get("c", F.lit(0)).rlike(r"^Vínculo:\s*\S+\s*/\s*Matrícula:\s*\S+"), F.lit(False))
    rows = running_sum(rows, file, number, start, "_block", chunk).filter("_block > 0")
    first, second = F.coalesce(F.get("c", F.lit(0)), F.lit("")), F.coalesce(F.get("c", F.lit(1)), F.lit(""))
    cell = lambda i: F.coalesce(F.get("c", F.lit(i)), F.lit(""))
    labelled = lambda head, i, label: F.max(F.when(first.startswith(head), some(cell(i), rf"(?s)^{label}\s*:\s*(.*?)\s*$")))
    foot = lambda label: F.max(F.when(first.contains("Remuneração Bruta:"), some(first, rf"{label}:\s*([0-9.,]+)")))
    is_rubric = first.rlike("^[0-9]+$")
    rubric = F.struct(F.col(number).alias("n"), first.alias("code"), second.alias("description"), some(cell(2), r"^(.+)$").alias("reference"), plain_number(cell(3)).alias("earnings"), plain_number(cell(4)).alias("deductions"))
    got = rows.groupBy(file, "_block").agg(
        F.max(some(first, r"^Vínculo:\s*(\S+)")).alias("bond"), F.max(some(first, r"Matrícula:\s*(\S+)")).alias("registration"), labelled("Vínculo", 1, "Nome").alias("name"), labelled("Vínculo", 2, "CPF").alias("masked_id"),
        labelled("Vínculo", 3, "Situação").alias("status"), labelled("Forma de Admissão", 0, "Forma de Admissão").alias("admission"), labelled("Forma de Admissão", 1, "Cargo").alias("job"), labelled("Forma de Admissão", 2, "Função").alias("function"),
        labelled("Secretaria", 0, "Secretaria").alias("department"), labelled("Secretaria", 1, "Salário base").alias("salary"), labelled("Secretaria", 2, "Competência").alias("period"), labelled("Secretaria", 3, "Carga horária semanal/plantões").alias("hours"),
        labelled("Lotação", 0, "Lotação").alias("assignment"), labelled("Lotação", 1, "Sigla do Cargo").alias("job_code"), labelled("Lotação", 2, "Data de Admissão").alias("admitted_on"),
        foot("Remuneração Bruta").alias("gross"), foot("Total da Remuneração Após Deduções").alias("net"), F.min(F.when(first.contains("Remuneração Bruta:"), F.col(number))).alias("_foot"),
        F.max(F.when((first == "Cód") & (second == "Descrição"), F.col(number))).alias("_head"), F.array_sort(F.collect_list(F.when(is_rubric, rubric))).alias("_rubrics"),
    ).filter("_foot IS NOT NULL")
    part = lambda g: F.regexp_extract("period", "([0-9]{2})/([0-9]{4})", g).try_cast("int")
    inside = F.filter("_rubrics", lambda r: (r["n"] > F.col("_head")) & (r["n"] < F.col("_foot")))
    return got.select(
        file, "bond", "registration", part(2).alias("year"), part(1).alias("month"), "name", "masked_id", "status", "admission", "job", "function", "department", "assignment", "job_code", "admitted_on", "hours",
        plain_number(F.col("salary")).alias("base_salary"), plain_number(F.col("gross")).alias("gross"), plain_number(F.col("net")).alias("net"), F.transform(inside, lambda r: r.dropFields("n")).alias("rubrics"),
    )


def payroll_blocks(lines: DataFrame, file: str, number: str, line: str) -> DataFrame:
    """Records of a payroll report: a block runs from its registration to its totals; one without totals is left out.

    Lines are ``key;value`` pairs and, between them, rubrics ``code;name;earnings;deductions``.
    """
    rows = logical_lines(lines, file, number, line)
    w = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_block", F.sum(F.col(line).startswith("REGISTRATION;").cast("int")).over(w)).filter("_block > 0")
    value = lambda key: F.max(some(F.col(line), f"(?s)^{key};(.*)$"))
    rubric = F.col(line).rlike("^[0-9]+;")
    out = rows.groupBy(file, "_block").agg(
        value("REGISTRATION").alias("registration"), value("DEPARTMENT").alias("department"), value("PERIOD").alias("period"), value("TOTALS").alias("totals"),
        F.count_if(rubric).alias("n_rubrics"), F.sum(F.when(rubric, parse_money(F.split_part(F.col(line), F.lit(";"), F.lit(3))))).alias("earnings"),
    )
    kept = out.filter(F.col("totals").isNotNull())
    return kept.select(
        file, "registration", "department", F.split_part("period", F.lit("/"), F.lit(1)).cast("int").alias("month"), F.split_part("period", F.lit("/"), F.lit(2)).cast("int").alias("year"),
        parse_money(some(F.col("totals"), r"Gross: *([0-9.,]+)")).cast("double").alias("gross"), parse_money(some(F.col("totals"), r"Net: *([0-9.,]+)")).cast("double").alias("net"),
        "n_rubrics", F.col("earnings").cast("double").alias("earnings"),
    )


def labelled(html: Column, label: str) -> Column:
    """The text behind a label of a page, tags and hard blanks aside."""
    plain = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"(&nbsp;|\s)+", " ")
    return F.trim(some(plain, rf"{label}: ?([^:]*?)(?: [A-Z][a-z]+:|$| \|)"))


def file_format(name: Column) -> Column:
    """How a file is read, by the last known suffix in its name; PDF if there is none."""
    found = F.regexp_extract_all(F.lower(name), F.lit(r"\.(pdf|xlsx?|ods|csv|docx?|txt|html?|json|zip|rar)\b"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(last.isin("xls", "xlsx", "ods"), "sheet").when(last == "docx", "docx").when(last == "doc", "doc").when(last.isin("zip", "rar"), "rejected").when(last.isin("csv", "txt", "htm", "html", "json"), "text").otherwise("pdf")


def award(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Winner, value, day and control number that a decision states, and how sure that is.

    The first of the ordered patterns that finds something counts; an amount said
    to be per unit is none.
    """
    c = F.col(text)
    first = lambda *patterns: F.coalesce(*[some(c, p) for p in patterns])
    value = F.coalesce(*[parse_money(some(c, p)) for p in (r"(?i)total value of R\$ ?([0-9.]+,[0-9]{2})(?! *(?:per|/) *unit)", r"(?i)value[^0-9]{0,20}R\$ ?([0-9.]+,[0-9]{2})(?! *(?:per|/) *unit)")])
    out = docs.select(
        key, first(r"(?i)winner: ([^,.;\n]{3,80})", r"(?i)awarded to ([^,.;\n]{3,80}?)(?: for| with|[,.;\n])").alias("winner"), value.cast("double").alias("value"),
        F.coalesce(F.try_to_date(some(c, r"(?i)homologated[^0-9]{0,40}([0-9]{2}/[0-9]{2}/[0-9]{4})"), "dd/MM/yyyy")).cast("string").alias("day"), some(c, r"\b([0-9]{14}-[0-9]-[0-9]{6}/[0-9]{4})\b").alias("control"),
    )
    found = sum((F.col(n).isNotNull().cast("int") for n in ("winner", "value", "day", "control")), F.lit(0))
    return out.withColumn("confidence", F.least(F.lit(0.95), F.round(F.lit(0.45) + 0.13 * found, 2)))


def item_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Numbered items of a text: number, description, quantity, unit and unit price."""
    each = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^([0-9]{1,4}\. [^\n]+)$"), F.lit(1))).alias("line"))
    p = r"^([0-9]+)\. (.+?) - ([0-9]+) ([A-Z]{1,4}) - R\$ ([0-9.]+,[0-9]{2})$"
    rows = each.select(key, *[F.regexp_extract("line", p, g).alias(n) for g, n in enumerate(("item", "description", "quantity", "unit", "price"), 1)]).filter("item <> ''")
    return rows.select(key, F.col("item").cast("int").alias("item"), "description", F.col("quantity").cast("int").alias("quantity"), "unit", parse_money(F.col("price")).cast("double").alias("price"))


def _result(said: list[Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["0"].cast("int").alias("item"), x["1"].alias("supplier"), parse_money(x["2"]).cast("double").alias("value"), *said)


def item_results(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Results of items in three layouts; an item's first layout counts: negotiation, ranking, declared."""
    layouts = (("negotiated", 0.92, r"Item ([0-9]+) negotiated with ([^:\n]+): R\$ ([0-9.]+,[0-9]{2})"), ("ranked", 0.88, r"Item ([0-9]+) 1st place ([^:\n]+): R\$ ([0-9.]+,[0-9]{2})"),
               ("declared", 0.86, r"Item ([0-9]+) result ([^:\n]+): R\$ ([0-9.]+,[0-9]{2})"))
    parts = []
    for rank, (name, sure, p) in enumerate(layouts):
        lists = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in (1, 2, 3)]
        found = F.arrays_zip(*lists)
        said = [F.lit(rank).alias("rank"), F.lit(name).alias("layout"), F.lit(sure).alias("confidence")]
        parts.append(F.transform(found, _result(said)))
    each = docs.select(key, F.explode(F.concat(*parts)).alias("r")).select(key, "r.*")
    w = Window.partitionBy(key, "item").orderBy("rank", "supplier", "value")
    return each.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at", "rank")


def labelled_fields(docs: DataFrame, key: str, text: str, labels: list[str]) -> DataFrame:
    """What stands behind each label, as far as the next known one."""
    ahead = "|".join(labels)
    return docs.select(key, *[F.trim(some(F.col(text), rf"(?s){label}:\s*(.{{1,800}}?)(?=\s*(?:{ahead}):|$)")).alias(label.lower()) for label in labels])


def decree(c: Column) -> list[Column]:
    """Number, day phrase and authority of a decree, and total and source of a credit it opens."""
    return [
        some(c, r"(?i)decree n[o.º]* ?([0-9.]+)").alias("number"), some(c, r"(?i), of ([0-9]{1,2} of [a-z]+ of [0-9]{4})").alias("day_phrase"), some(c, r"(?i)\bthe ([A-Z][a-z]+) of ").alias("authority"),
        parse_money(some(c, r"(?i)credit[^$]{0,60}R\$ ?([0-9.]+,[0-9]{2})")).cast("double").alias("credit"), F.coalesce(some(c, r"(?i)from (excess revenue|annulment|surplus)"), F.lit("unreadable")).alias("source"),
    ]


def cited_laws(docs: DataFrame, key: str, text: str, years: tuple[int, int]) -> DataFrame:
    """key, number, year of laws cited, once each, with a plausible year."""
    found = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)law n?[o.º]* ?([0-9.]{1,7}/[0-9]{4})"), F.lit(1)))).alias("law"))
    number, year = F.replace(F.split_part("law", F.lit("/"), F.lit(1)), F.lit("."), F.lit("")), F.split_part("law", F.lit("/"), F.lit(2)).cast("int")
    return found.select(key, number.cast("int").alias("number"), year.alias("year")).filter(F.col("year").between(*years)).distinct()


def facts(docs: DataFrame, key: str, text: str, taxonomy: dict[str, str], quantity: str) -> DataFrame:
    """One fact for each quantity of a topic that a text is about, or one without a quantity. The taxonomy is a parameter."""
    topics = F.array_compact(F.array(*[F.when(fold_lower(F.col(text)).rlike(p), F.lit(t)) for t, p in taxonomy.items()]))
    found = docs.select(key, F.explode(topics).alias("topic"), F.regexp_extract_all(text, F.lit(quantity), F.lit(1)).alias("q"))
    each = found.select(key, "topic", F.explode(F.when(F.size("q") > 0, F.col("q")).otherwise(F.array(F.lit(None).cast("string")))).alias("quantity"))
    return each.withColumn("quantity", F.col("quantity").cast("bigint"))


def event_name(c: Column) -> Column:
    """Numbered fairs, carnivals and festivals with up to five words behind."""
    t = fold_lower(c)
    return F.trim(some(t, r"((?:[0-9]+[ao]? (?:fair|feira)|carnaval|carnival|festival)(?: [a-z0-9]+){0,5})"))


def sole_amount(c: Column) -> Column:
    found = F.array_distinct(amounts(c))
    return F.when(F.size(found) == 1, found[0])
