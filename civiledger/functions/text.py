"""Text as columns: folding, keys, tokens, similarity, masking and chunks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that decompose into a plain one and marks; marks that stand alone are taken out.
_PLAIN_OF = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0].isascii()}
ACCENTED = "".join(_PLAIN_OF) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(_PLAIN_OF.values())


def fold(c: Column) -> Column:
    """Letters without their accents."""
    return F.translate(c, ACCENTED, PLAIN)


def fold_lower(c: Column) -> Column:
    return F.lower(fold(c))


def fold_upper(c: Column) -> Column:
    return F.upper(fold(c))


def slug(c: Column) -> Column:
    """Folded, anything but letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold_lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def payee_key(tax_id: Column, name: Column) -> Column:
    """Fourteen digits stand for themselves, else the name's slug; null without either."""
    return F.when(F.length(digits(tax_id)) == 14, digits(tax_id)).when(F.length(slug(name)) > 0, F.concat(F.lit("pf-"), slug(name)))


def tax_id_or_null(c: Column) -> Column:
    """Only digits of the right number that are not all alike."""
    d = digits(c)
    return F.when(F.length(d).isin(11, 14) & ~d.rlike(r"^(\d)\1*$"), d)


def tokens(c: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct folded words of at least ``least`` letters, in order of first use."""
    words = F.filter(F.split(fold_lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)
    return F.array_distinct(words)


def object_key(c: Column) -> Column:
    return F.array_join(F.slice(tokens(c), 1, 3), " ")


def sorted_token_key(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def mask(c: Column) -> Column:
    """Personal numbers, addresses and phones as marks."""
    for pattern, mark in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[email]"),
        (r"\d{3}\.\d{3}\.\d{3}-\d{2}", "[cpf]"),
        (r"(?i)cpf[: ]*\d{11}", "[cpf]"),
        (r"\+?\d{0,3} ?\(\d{2,3}\) ?\d{3,5}-\d{4}", "[phone]"),
    ):
        c = F.regexp_replace(c, pattern, mark)
    return c


def chunks(c: Column, size: int, overlap_: int) -> Column:
    """Pieces of ``size`` characters that overlap, trimmed, the empty ones left out."""
    step = max(size - overlap_, 1)
    n = F.length(c)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap_) / step), F.lit(1)).cast("int") - 1)
    pieces = F.transform(starts, lambda i: F.trim(F.substring(c, i * step + 1, F.lit(size))))
    return F.filter(pieces, lambda p: F.length(p) > 0)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def line_quality(line: Column) -> Column:
    """Whether enough of a line's parts are words or numbers."""
    parts = F.filter(F.split(line, "[ \t]+"), lambda w: F.length(w) > 0)
    real = F.size(F.filter(parts, lambda w: fold(w).rlike(r"^[A-Za-z]{3,}[.,;:]?$") | w.rlike(r"^[0-9][0-9.,/-]*$")))
    return (F.size(parts) > 0) & ((real >= 3) | (real * 10 >= F.size(parts) * 4))


def repair_mojibake(c: Column) -> Column:
    """Text read in the wrong charset, repaired where that leaves fewer marks of it."""
    marks = lambda x: F.length(x) - F.length(F.regexp_replace(x, "[ÃÂ]", ""))
    # strict coding functions fail on what they cannot code, so that is put aside first
    low = F.regexp_replace(c, "[^\\x00-\\xFF]", "?")
    fixed = F.try_validate_utf8(F.encode(low, "ISO-8859-1").cast("string"))
    return F.when(c.rlike("[ÃÂ]") & ~c.rlike("[^\\x00-\\xFF]") & fixed.isNotNull() & (marks(fixed) < marks(c)), fixed).otherwise(c)


def references(c: Column) -> Column:
    """Numbers of the form N/YYYY, as a list."""
    return F.regexp_extract_all(c, F.lit(r"\b([0-9]{1,6}/(?:19|20)[0-9]{2})\b"), F.lit(1))


def compatible_titles(a: Column, b: Column, least: float = 0.5) -> Column:
    """References must meet where both have any, and the tokens must be alike."""
    ra, rb = references(a), references(b)
    meet = (F.size(ra) == 0) | (F.size(rb) == 0) | F.arrays_overlap(ra, rb)
    return meet & (jaccard(tokens(a), tokens(b)) >= least)


def excerpt(c: Column, needle: str, around: int = 40) -> Column:
    """What stands around the first match, blanks collapsed; null without one."""
    at = F.locate(needle, fold_lower(c))
    cut = F.substring(c, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(needle)))
    return F.when(at > 0, F.trim(F.regexp_replace(cut, r"\s+", " ")))


def numeric_signature(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))))


def stable_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
