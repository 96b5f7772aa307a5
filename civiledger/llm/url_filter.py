"""URL filter: rules on host and path, and a ratio of two character models for what no rule decides.

The URLs that rules allow and those that they block each teach a Markov model of
characters over host and path. Its order varies from place to place: from order
0 up, the share of the next character after a context is smoothed by that after the
context one shorter, with a weight of ``MU`` characters, so a context never seen
leaves the shorter one's share as it is. Contexts of up to two characters are
exact, longer ones share ``LONG`` buckets each, so a model is a table of bounded
size (:data:`CELLS` counts), however many URLs there are.

A URL's score is the difference of its log-likelihoods under both models, allowed
less blocked, divided by its number of characters, the end included. Scores are
calibrated on URLs that the scoring model has not seen: the rule-decided URLs
fall into two halves by their hash, each half is scored by the other half's
models, and a logistic curve is fitted to the histogram of those scores with both
verdicts weighing the same. What no rule decides is blocked where the curve, at the
score of the models of both halves, gives blocking at least one half.

Tasks count in a table of their own and hand on one count for each cell seen; all
URLs teach, with repeats. Nothing is grouped by host or URL.

Cases: a null URL, or one without ``://``, has an empty host and path, which no
rule fits; its score is that of an empty string. An empty path fits only rules
without a path. Repeated rows count and are judged each. Very long URLs are read
whole. Characters outside printable ASCII count as one. If no URL is allowed by
rules, or none is blocked, the score is null and what is left is allowed. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Host, path and verdict. A rule fits the host and its subdomains and paths that start so; the longest decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 4
#: Printable ASCII without capitals (folded), one sign for all others, begin and end.
SIGNS = 72
LONG = 1 << 13
MU = 4.0
#: Histogram cells to a nat.
FINE = 256
_OTHER, _BEGIN, _END = 69, 70, 71
_SIGN = np.full(256, _OTHER, np.int64)
_SIGN[32:127] = [[c for c in range(32, 127) if not 65 <= c <= 90].index(c + 32 if 65 <= c <= 90 else c) for c in range(32, 127)]
_SIZES = [SIGNS**k if k <= 2 else LONG for k in range(ORDER + 1)]
_AT = np.concatenate([[0], np.cumsum(_SIZES)])
#: Counts in a model: each context's bucket by each next sign.
CELLS = int(_AT[-1]) * SIGNS
_ODD = np.uint64(0x9E3779B97F4A7C15)


def parts(url: Column | str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def decided(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the columns ``host`` and ``path``, as written, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def cells(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The URL that each sign (and each end) is of, and its cell for each order, one row an order."""
    raw = [u.encode("ascii", "replace") if u.isascii() else "".join(c if c.isascii() else "\x7f" for c in u).encode() for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    size = lengths + ORDER + 1
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    signs = np.full(int(size.sum()), _BEGIN, np.int64)
    owner = np.repeat(np.arange(len(urls)), lengths)
    within = np.arange(int(lengths.sum())) - np.repeat(np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    signs[begin[owner] + ORDER + within] = _SIGN[np.frombuffer(b"".join(raw), np.uint8)]
    signs[begin + size - 1] = _END
    at = np.flatnonzero(np.arange(len(signs)) - np.repeat(begin, size) >= ORDER)
    context, out = np.zeros(len(at), np.uint64), np.empty((ORDER + 1, len(at)), np.int64)
    for k in range(ORDER + 1):
        if k:
            context = context * np.uint64(SIGNS) + signs[at - k].astype(np.uint64)
        bucket = context if k <= 2 else (context * _ODD) >> np.uint64(64 - LONG.bit_length() + 1)
        out[k] = (_AT[k] + bucket.astype(np.int64)) * SIGNS + signs[at]
    return np.repeat(np.arange(len(urls)), lengths + 1), out


def train(rows: DataFrame) -> np.ndarray:
    """Counts by half, verdict (allow, block) and cell, of rows with columns judged_url, half and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * CELLS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                kind = part.column(1).to_numpy(zero_copy_only=False) * 2 + part.column(2).to_numpy(zero_copy_only=False)
                owner, found = cells(part.column(0).to_pylist())
                seen, n = np.unique(found + kind[owner] * CELLS, return_counts=True)
                total[seen] += n
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    counted = rows.select("judged_url", "half", "block").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * CELLS, np.int64)
    out[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    return out.reshape(2, 2, CELLS)


class Ratio:
    """Both models' counts; scores whole lists of URLs."""

    def __init__(self, counts: np.ndarray):
        """``counts`` has the allowed URLs' cells, then the blocked ones'."""
        (seen,) = np.nonzero(counts.any(0))
        self.seen, self.counts, self.tables = seen, counts[:, seen], None

    def score(self, urls: list[str]) -> np.ndarray:
        """Log-likelihood a sign under the first model less that under the second."""
        if self.tables is None:
            full = np.zeros((2, CELLS))
            full[:, self.seen] = self.counts
            self.tables = full, full.reshape(2, -1, SIGNS).sum(2)
        owner, found = cells(urls)
        total = []
        for counts, sums in zip(*self.tables, strict=True):
            p = np.full(found.shape[1], 1 / SIGNS)
            for row in found:
                p = (counts[row] + MU * p) / (sums[row // SIGNS] + MU)
            total.append(np.bincount(owner, np.log(p), len(urls)))
        return (total[0] - total[1]) / np.bincount(owner, minlength=len(urls))


def calibrate(at: np.ndarray, allowed: np.ndarray, blocked: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds for allowing at a score, with both verdicts weighing the same."""
    x = np.concatenate([at, at])
    y = np.concatenate([np.ones(len(at)), np.zeros(len(at))])
    w = np.concatenate([allowed / allowed.sum(), blocked / blocked.sum()])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum()])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _scored(rows: DataFrame, ratios: list[Ratio]) -> DataFrame:
    """The rows' other columns and ``score``, by the model that ``half`` picks."""
    keep = [c for c in rows.columns if c not in ("judged_url", "half")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                half, urls = part.column(1).to_numpy(zero_copy_only=False), part.column(0).to_pylist()
                score = np.zeros(len(urls))
                for k in np.unique(half).tolist():
                    (own,) = np.nonzero(half == k)
                    score[own] = ratios[k].score([urls[i] for i in own.tolist()])
                yield pa.RecordBatch.from_arrays([*[part.column(i + 2) for i in range(len(keep))], pa.array(score)], [*keep, "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep]
    return rows.select("judged_url", "half", *keep).mapInArrow(run, ", ".join([*kinds, "score double"]))


def fit(judged: DataFrame) -> tuple[Ratio, float, float] | None:
    """The models of all rule-decided URLs and the calibration; None without URLs of both verdicts.

    ``judged`` has host, path and verdict.
    """
    rows = judged.filter("verdict IS NOT NULL").select(F.concat("host", "path").alias("judged_url"), F.expr("CAST(verdict = 'block' AS BIGINT)").alias("block"))
    rows = rows.withColumn("half", F.expr("pmod(xxhash64(judged_url), 2)"))
    counts = train(rows)
    if not counts.any((0, 2)).all():
        return None
    other = [Ratio(counts[1]), Ratio(counts[0])]
    histogram = _scored(rows, other).groupBy(F.floor(F.col("score") * FINE).alias("cell"), "block").count().collect()
    at = sorted({r["cell"] for r in histogram})
    n = np.zeros((2, len(at)))
    for r in histogram:
        n[r["block"], at.index(r["cell"])] = r["count"]
    return Ratio(counts.sum(0)), *calibrate((np.array(at) + 0.5) / FINE, n[0], n[1])


def judge(pages: DataFrame, *carry: str, rules=RULES) -> DataFrame:
    """page_id, the columns to carry, host, path, rule, verdict, score and block_share of each page."""
    host, path = parts()
    rows = pages.select("page_id", *carry, host.alias("host"), path.alias("path"))
    name, verdict = decided(rules)
    judged = stored(rows.select("*", name.alias("rule"), verdict.alias("verdict")), "urls")
    fitted = fit(judged)
    names = ["page_id", *carry, "host", "path", "rule", "verdict"]
    if fitted is None:
        nothing = F.lit(None).cast("double")
        return judged.select(*names[:-1], F.coalesce("verdict", F.lit("allow")).alias("verdict"), nothing.alias("score"), nothing.alias("block_share"))
    ratio, a, b = fitted
    scored = _scored(judged.select(*names, F.concat("host", "path").alias("judged_url"), F.lit(0).alias("half")), [ratio])
    scored = scored.withColumn("block_share", 1 / (1 + F.exp(F.col("score") * a + b)))
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_share") >= 0.5, "block").otherwise("allow")))


def allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages that are not blocked: page_id, url, html."""
    return judge(pages, "url", "html", rules=rules).filter("verdict = 'allow'").select("page_id", "url", "html")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score", "block_share")
