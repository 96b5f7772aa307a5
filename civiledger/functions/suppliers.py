"""Suppliers' names as columns: cleaned step by step, and why what is left may be no supplier's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_lower

# What minutes and contracts leave before and behind a name, in order; each goes, but for the group that is kept.
BEFORE = (
    r"(?i)^.*?\bDOCUMENTO\s+DA\s+EMPRESA\s+REPRESENTANTE\s+DOCUMENTO\s+DO\s+REPRESENTANTE\s+", r"(?i)^.*?\bDOCUMENTO\s+DO\s+REPRESENTANTE\s+", r"(?i)^.*?\bDOCUMENTO\s+DA\s+EMPRESA\s+",
    r"(?i)^.*?\bmg\s+gov\s+br\s+Produto\s+Vencedor\s+(?:LOTE\s+[0-9]+\s+)?", r"(?i)^.*?\brepresentando\s+a\s+(?:empresa\s+)?",
)
WORDS = (
    r"(?i)^(?:a\s+)?empresa\s+contratada\s*:?\s*", r"(?i)^(?:a\s+)?empresa\s+([^_]|_[^_])", r"(?i)^contratad[ao]\s*(?:raz[aã]o\s+social\s*:?)?\s*:?\s*", r"(?i)^raz[aã]o\s+social\s*:?\s*",
    r"(?i)\s*,?\s*(?:inscrita|inscrito)\s+no\s+cnpj.*$", r"(?i)\s*,?\s*neste\s+ato.*$", r"(?i)\s*,?\s*doravante.*$", r"(?i)\s*(?:,|-)?\s*(?:sob\s+o\s+)?CNPJ\s*(?:sob\s+o\s+)?(?:n[ºo°.]?\s*)?$", r"\s+\w?\]\s*$",
)
ENDS = r"^[.,;:–-]+|[,;:–-]+$"
# Families of folded names that are none.
INVALID = (
    ("empty", r"^(?:undefined|null|nan)?$"),
    ("placeholder", r"^(?:a\s+|o\s+|os\s+|as\s+)?(?:empresa\s+)?(?:contratad[ao]s?|contratantes?|licitantes?|proponentes?|permissionarias?|fornecedor(?:a|es)?|credor(?:a|es)?| adjudicatari[ao]s?)$|^vencedor(?:\(a\)|a|es)?(?:\s+d[ao]\s+licitacao|\s+do\s+certame|\s+do\s+processo)?$|^empresa\s*[_.\-\s]*$|_{3,}"),
    ("label", r"^(?:inscrit[ao]\s+no\s+)?cnpj(?:\s+sob\s+o)?(?:\s+n[ºo°.]?)?$"),
    ("address", r"^(?:cep\b|bairro\b|rua\b|av\.?\b|avenida\b|praca\b|cidade\s*:)|\bcep\s*[.:]?\s*[0-9]{2}\.?[0-9]{3}\s*-\s*[0-9]{3}|^[0-9]{2,3}\s*-\s*[0-9]{3}$|^[0-9./\-\s]+(?:cnpj)?$"),
    ("public body", r"^(?:prefeitura|camara) municipal$|^(?:departamento|secretaria|fundo|conselho)\s+municipal\b|pessoa juridica de direito publico|^de natureza publica$"),
)


def cleaned_name(c: Column, town: str = "") -> Column:
    """A name without what surrounds it, in its own letters; ``town`` is the folded name of the own municipality."""
    unicode = lambda p: p.replace("(?i)", "(?iu)")
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    for p in BEFORE:
        out = F.regexp_replace(out, unicode(p), "")
    if town:
        out = F.regexp_replace(out, rf"(?iu)^.*?\b(?:Prefeitura|C[aâ]mara)\s+Municipal\s+de\s+{town}(?:\s*[-–/]\s*[A-Z]{{2}})?\s*", "")
    for p in WORDS:
        out = F.regexp_replace(out, unicode(p), "$1" if "(" in p and "([" in p else "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), ENDS, ""))


def invalid_name(clean: Column, town: str = "") -> Column:
    """The family of a cleaned name that is no supplier's; null for a supplier's."""
    folded = F.trim(fold_lower(clean))
    out = F
    for reason, p in INVALID:
        out = out.when(folded.rlike(p), reason)
    out = out.when((F.length(folded) == 1) | ((F.length(folded) == 2) & (folded != "oi")), "short")
    if town:
        out = out.when(folded.rlike(rf"(?:prefeitura municipal|camara municipal|municipio|municipal) de {town}"), "public body")
    return out


def supplier(c: Column, town: str = "") -> Column:
    """struct(name, reason): the cleaned name, or null and why."""
    one = lambda n: F.struct(F.when(invalid_name(n, town).isNull(), n).alias("name"), invalid_name(n, town).alias("reason"))
    return F.get(F.transform(F.array(cleaned_name(c, town)), one), 0)
