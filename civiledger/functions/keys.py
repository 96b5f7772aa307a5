"""Keys and names of procurement, payees and laws as columns, and the guards and chains built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits, fold_lower, slug

# Kinds of procurement by the words of their folded names, in order.
MODALITIES = (
    ("pregao-eletronico", "pregao eletronico"),
    ("pregao-presencial", "pregao presencial"),
    ("pregao", "pregao"),
    ("tomada-de-precos", "tomada de precos?"),
    ("concorrencia", "concorrencia"),
    ("convite", "convite"),
    ("dispensa", "dispensa"),
    ("inexigibilidade", "inexigibilidade|inexigivel"),
    ("chamamento", "chamamento|chamada publica"),
)
# What stands before and behind suppliers' names, and what is no supplier.
NAME_STRIPS = (r"^(empresas?|fornecedor(a)?|contratad[oa]|vencedor(a)?)[ :-]+", r"[ ,-]+(inscrit[oa]|cnpj|cpf|com sede|no valor).*$", r"^[ .,;:-]+|[ .,;:-]+$")
NOT_SUPPLIERS = r"^(prefeitura|municipio|camara|estado|secretaria)\b|\b(rua|avenida|bairro|cep)\b|^[0-9 ./-]*$"


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def canonical_modality(c: Column) -> Column:
    """The kind of procurement, by the first rule that is met; null without one."""
    folded, out = fold_lower(c), F
    for name, pattern in MODALITIES:
        out = out.when(folded.rlike(pattern), name)
    return out


def modality_code(c: Column) -> Column:
    """type, number and year of ``type - NNNNYYYY`` with a year of 2010 to 2050, else null."""
    part = lambda g: F.regexp_extract(c, r"^\s*(.+?)\s*-\s*([0-9]{4})((?:20[1-4][0-9])|2050)\s*$", g)
    return F.when(part(3) != "", F.struct(canonical_modality(part(1)).alias("type"), part(2).cast("int").alias("number"), part(3).cast("int").alias("year")))


def modality_title(c: Column) -> Column:
    """type, number and year out of a title's dash segments; the segment of the process is passed over."""
    parts = F.filter(F.transform(F.split(fold_lower(c), " - "), lambda s: F.trim(s)), lambda s: ~s.startswith("processo"))
    kind = F.get(F.filter(F.transform(parts, lambda s: canonical_modality(s)), lambda k: k.isNotNull()), 0)
    number = F.get(F.filter(parts, lambda s: s.rlike("[0-9]+/[0-9]{4}")), 0)
    part = lambda g: F.regexp_extract(number, "([0-9]+)/([0-9]{4})", g).cast("int")
    return F.when(kind.isNotNull() & number.isNotNull(), F.struct(kind.alias("type"), part(1).alias("number"), part(2).alias("year")))


def process_key(c: Column) -> Column:
    """Two-digit years in full; the digits if there are four or more, else the folded text."""
    full = F.regexp_replace(c, r"/([0-9]{2})$", "/20$1")
    return F.when(F.length(digits(full)) >= 4, digits(full)).otherwise(F.trim(fold_lower(full)))


def control_number(c: Column) -> Column:
    """An external control number with its sequence padded to six digits, null if it is none."""
    part = lambda g: F.regexp_extract(c, r"^([0-9]{14})-([0-9])-([0-9]{1,6})/([0-9]{4})$", g)
    return F.when(part(1) != "", F.concat(part(1), F.lit("-"), part(2), F.lit("-"), F.lpad(part(3), 6, "0"), F.lit("/"), part(4)))


def document_number(c: Column) -> Column:
    """Without punctuation at its ends; null without a digit."""
    cut = F.regexp_replace(c, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    return F.when(cut.rlike("[0-9]"), cut)


def product_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold_lower(c), "[^a-z0-9]+", " "))


def payee_parts(c: Column) -> tuple[Column, Column]:
    """Code and name of ``code - name``; without a code the whole is the name."""
    part = lambda g: F.regexp_extract(c, r"^\s*([0-9]+)\s*-\s*(.+?)\s*$", g)
    return _some(part(1)), F.coalesce(_some(part(2)), F.trim(c))


def payee_key_parts(c: Column) -> tuple[Column, Column, Column]:
    """What kind of payee key it is (tax or name, null if none), the tax id and the slug."""
    tax, name = c.rlike("^[0-9]{14}$"), c.rlike("^pf-.")
    return F.when(tax, "tax").when(name, "name"), F.when(tax, c), F.when(name, F.substring(c, 4, 1_000_000))


def formatted_tax_id(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")).otherwise(c)


def supplier_name(c: Column) -> Column:
    """Stripped step by step of what is not the name; null if what is left is an address, a number or a public body."""
    out = F.trim(fold_lower(c))
    for pattern in NAME_STRIPS:
        out = F.regexp_replace(out, pattern, "")
    return F.when((F.length(out) >= 3) & ~out.rlike(NOT_SUPPLIERS), F.upper(out))


def person_slug(c: Column) -> Column:
    """A slug in which junior is short."""
    return F.regexp_replace(slug(c), "-junior(-|$)", "-jr$1")


def authors(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def is_garbage_unit(c: Column) -> Column:
    """Units without a letter, or that are numbers or single signs."""
    return c.isNull() | ~fold_lower(c).rlike("[a-z]") | (F.length(F.trim(c)) > 20)


def deep_link(year: Column, number: Column, base: str) -> Column:
    """The entry's own page where number and year allow it, else the general one."""
    good = number.rlike("^[0-9]{5}-[0-9]{3}$") & year.between(2000, 2100)
    return F.when(good, F.concat(F.lit(base + "/entry/"), year.cast("string"), F.lit("/"), number)).otherwise(F.lit(base + "/search"))


def escape_like(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_terms(q: str, most: int = 8) -> list[str]:
    """Folded terms of a search, operators and signs left out. The search is defined over the first ``most``; more are an error."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", q.lower()) if not unicodedata.combining(c))
    terms = [t for t in re.split("[^a-z0-9]+", plain) if t and t not in ("and", "or", "not", "near")]
    if len(terms) > most:
        raise ValueError(f"a search takes {most} terms at most")
    return terms


def period_years(year: int | None, term: int | None) -> list[int] | None:
    """A year goes before a term, a term (by its first year) before all: None."""
    return [year] if year else list(range(term, term + 4)) if term else None


# values and states


def best_value(total: Column, lot: Column, whole: Column, unit: Column, quantity: Column) -> tuple[Column, Column]:
    """The best value available and which one it is: total, lot, whole, unit times quantity, unit."""
    return _chain([("total", total), ("lot", lot), ("whole", whole), ("product", unit * quantity), ("unit", unit)])


def checked_value(total: Column, lot: Column, whole: Column, unit: Column, quantity: Column) -> tuple[Column, Column]:
    """The order that validation takes: whole, lot, total, unit times quantity, unit."""
    return _chain([("whole", whole), ("lot", lot), ("total", total), ("product", unit * quantity), ("unit", unit)])


def _chain(steps: list[tuple[str, Column]]) -> tuple[Column, Column]:
    return F.coalesce(*[F.when(v > 0, v) for _, v in steps]), F.coalesce(*[F.when(v > 0, F.lit(n)) for n, v in steps])


def payment_state(settled: Column, paid: Column) -> Column:
    return F.when(paid.isNotNull(), "paid").when(settled.isNotNull(), "settled").otherwise("committed")


def item_plausibility(item: Column, process: Column, ceiling: float = 1e8) -> Column:
    """Whether an item's value can be part of its process's."""
    return F.when(item > ceiling, "ceiling").when((process > 0) & (item / process > 1.05), "above-process").otherwise("ok")


def value_kind(name: Column, quantity: Column) -> Column:
    """What a value stands for: lot, whole, unit or total."""
    t = fold_lower(name)
    return F.when(t.rlike(r"\blote?\b"), "lot").when(t.rlike("global|whole"), "whole").when(quantity == 1, "unit").otherwise("total")


def exact_link(a: Column, b: Column) -> Column:
    """Whether two parsed modalities agree in type, number and year."""
    return F.coalesce((a["type"] == b["type"]) & (a["number"] == b["number"]) & (a["year"] == b["year"]), F.lit(False))


# arrays


def has_run(words: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``words`` without a gap."""
    starts = F.sequence(F.lit(1), F.size(words) - F.size(run) + 1)
    found = F.exists(starts, lambda i: F.slice(words, i, F.size(run)) == run)
    return F.when((F.size(run) > 0) & (F.size(words) >= F.size(run)), found).otherwise(F.lit(False))


def matched_terms(words: Column, terms: list[str]) -> Column:
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))
