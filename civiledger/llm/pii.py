"""Personal data: exact patterns and a character tagger for other spellings.

The base spans are those of fixed patterns. A bidirectional LSTM with a CRF
(``tagger``) reads every text whole, in overlapping windows. The windows are
decoded and reconciled over the text: where the best path of a window has a tag
at all, it and the neighbours that a tag may reach into are put together, each character scored by the
window that it lies deepest in, and the CRF is decoded once along the whole
stretch; windows where no path beats no tag by ``LEAST_SCORE`` need no more. A tagged span is added
if it beats no tag by ``LEAST_SCORE``, once widened to whole words, is of a
possible kind (digits in the right number, a passing check digit, parts up to
255, an at sign or word between letters) and overlaps no base span; base spans
always stay. ``redact`` replaces all spans by their kind.

Counts are of the base spans; ``n_added`` counts what the tagger adds.

Cases: null texts count as empty. Texts of any length are read whole, in time in
proportion to their length. Repeated rows come out each, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, documents, pick
from .tagger import KINDS, PAD, TAGS, Tagger, encode, luhn, trained

Span = tuple[int, int, str]
# The patterns are those of the contract, written so that they take linear time:
# a number starts where no digit stands before it, and the local part of an
# address is read back from its at sign.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HAS_DIGIT = re.compile("[0-9]")
#: Characters of a window and from one to the next; windows read at once, characters of texts handled at once.
WINDOW, STRIDE, ROWS, CHARS = 128, 104, 768, 1 << 22
LEAST_SCORE = 3.0
#: A tag's score this much under that of none may still be part of a span.
NEARLY = 0.0
#: What widens a span of each kind to a whole word, on its left and right.
_WIDER = {k: re.compile(r"[A-Za-z0-9._%+-]" if k == "email" else "[0-9]") for k in KINDS}
#: The rest of a domain and what dots in brackets join to it.
_REST = re.compile(r"[A-Za-z0-9.-]*(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)*", re.IGNORECASE)
_ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.IGNORECASE
)
#: No spelling of an address is longer.
LONGEST_ADDRESS = 512
_NUMBER = re.compile(r"[+(]?[0-9](?:[^A-Za-z]*[0-9])?")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    out: list[Span] = []
    last = at = 0
    while "@" in text and (at := text.find("@", at)) >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            last = at = found.end()
        else:
            last = at = at + 1
    if _HAS_DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _holds(text: str, a: int, b: int, kind: str, least: int = 0) -> Span | None:
    """A tagged span from ``least`` on, widened to whole words, if it can be of its kind."""
    wider = _WIDER[kind]
    while a > least and wider.match(text[a - 1]) and wider.match(text[a]):
        a -= 1
    while b < len(text) and wider.match(text[b]) and wider.match(text[b - 1]):
        b += 1
    if kind == "email":
        b = _REST.match(text, b).end()
    if kind == "email" and b - a > LONGEST_ADDRESS:
        return None
    # the tagger says where something is; what it takes along of the words around is left
    core = (_ADDRESS if kind == "email" else _NUMBER).search(text, a, b)
    if core is None:
        return None
    a, b = core.span()
    if (a and text[a - 1].isalnum()) or text[b : b + 1].isalnum():
        return None
    said, digits = core[0], _NOT_DIGIT.sub("", core[0])
    good = {
        "email": lambda: True,
        "ip": lambda: len(parts := re.findall("[0-9]+", said)) == 4 and all(map(_small, parts)),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 7 <= len(digits) <= 15,
    }[kind]()
    return (a, b, kind) if good else None


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of a tag sequence."""
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    new = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (tags % 2 == 1))
    ends = np.append(new, len(tags))[1:]
    return [(a, b, k - 1) for a, b, k in zip(new.tolist(), ends.tolist(), kind[new].tolist(), strict=True) if k]


def _stretches(code: np.ndarray, sizes: np.ndarray, tagger: Tagger) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, start, emissions by time and tag) of all stretches of windows that may hold spans, for texts side by side."""
    counts = np.maximum(-(-(sizes - WINDOW) // STRIDE), 0) + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
    begins = (np.cumsum(sizes) - sizes)[owner] + number * STRIDE
    left = sizes[owner] - number * STRIDE
    code = np.append(code, np.full(WINDOW, PAD, code.dtype))
    steps, margin = np.arange(WINDOW), (WINDOW - STRIDE) // 2
    open_ = None  # text, start, pieces of the stretch that goes on, and the row it had last
    for top in range(0, len(owner), ROWS):
        # one row more on either side tells which rows have a neighbour with a tag
        a, b = max(0, top - 1), min(len(owner), top + ROWS + 1)
        x = np.where(steps < left[a:b, None], code[begins[a:b, None] + steps], PAD)
        e = tagger.emissions(x)
        some = ~tagger.none_best(e, LEAST_SCORE)
        # a neighbour is needed where a tag is not far behind none in what both windows read
        close = e[:, 1:].max(axis=1) > e[:, 0] - NEARLY
        shared, together = WINDOW - STRIDE, owner[a + 1 : b] == owner[a : b - 1]
        near = some.copy()
        near[1:] |= some[:-1] & together & close[-shared:, :-1].any(axis=0)
        near[:-1] |= some[1:] & together & close[:shared, 1:].any(axis=0)
        for r in (np.flatnonzero(near[top - a : top - a + ROWS]) + top).tolist():
            i, scores = int(owner[r]), e[:, :, r - a]
            if open_ and (open_[0] != i or open_[3] != r - 1):
                yield open_[0], open_[1], np.concatenate(open_[2])
                open_ = None
            # a window's edges belong to its neighbours, if these are in the stretch
            first = margin if open_ else 0
            if open_:
                open_[2][-1] = open_[2][-1][: len(open_[2][-1]) - (WINDOW - STRIDE - margin)]
            else:
                open_ = [i, int(number[r]) * STRIDE, [], r]
            open_[2].append(scores[first : min(WINDOW, int(left[r]))])
            open_[3] = r
    if open_:
        yield open_[0], open_[1], np.concatenate(open_[2])


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """What the tagger adds to each text's base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    groups = np.cumsum(sizes) // CHARS
    for g in np.unique(groups):
        members = np.flatnonzero((groups == g) & (sizes > 0)).tolist()
        if not members:
            continue
        found = [(members[i], at, e) for i, at, e in _stretches(encode("".join(texts[i] for i in members)), sizes[members], tagger)]
        for i, at, tags, e in _decoded(found, tagger):
            text, taken = texts[i], base[i]
            spans = []
            for a, b, k in _spans(tags):
                if tagger.score(e[a:b], tags[a:b]) >= LEAST_SCORE:
                    span = _holds(text, at + a, at + b, KINDS[k], spans[-1][1] if spans else 0)
                    if span and not any(s[0] < span[1] and s[1] > span[0] for s in taken) and not (spans and spans[-1][1] > span[0]):
                        spans.append(span)
            out[i] += spans
    return [sorted(s) for s in out]


def _decoded(found: list[tuple[int, int, np.ndarray]], tagger: Tagger) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Decode stretches together that are of like length."""
    found = sorted(found, key=lambda f: len(f[2]))
    at = 0
    while at < len(found):
        to = at + 1
        while to < len(found) and to - at < ROWS and len(found[to][2]) <= 2 * len(found[at][2]):
            to += 1
        longest = len(found[to - 1][2])
        e = np.full((longest, TAGS, to - at), -1e4, np.float32)
        e[:, 0] = 0
        for k, (_, _, scores) in enumerate(found[at:to]):
            e[: len(scores), :, k] = scores
        for (i, start, scores), tags in zip(found[at:to], tagger.paths(e), strict=True):
            yield i, start, tags[: len(scores)], scores
        at = to


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, tagger)
            kinds = [[k for *_, k in b] for b in base]
            out = [batch.column(0), *[pa.array([x.count(k) for x in kinds], pa.int64()) for k in KINDS]]
            out.append(pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b in base]))
            out.append(pa.array([_said(_ordered(b + m)) for b, m in zip(base, more, strict=True)], pa.string()))
            out.append(pa.array([len(m) for m in more], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """All documents with personal data masked and ``n_chars`` to match; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            more = added_spans(plain, base, tagger)
            new = [t and masked(t, _ordered(b + m)) for t, b, m in zip(texts, base, more, strict=True)]
            n = [old if was == now else len(now) for old, was, now in zip(batch.column("n_chars").to_pylist(), texts, new, strict=True)]
            columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(new, pa.string()), "n_chars": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    rows = pick(docs, *DOC_COLUMNS).withColumn("n_chars", F.col("n_chars").cast("bigint"))
    return rows.mapInArrow(run, rows.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), trained())
