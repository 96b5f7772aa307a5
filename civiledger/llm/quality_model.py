"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature's values fall into quantile bins and own a lookup table of
log-odds. Boosting goes round the features in cycles: a shallow tree over one
feature's bins is fitted to the gradients, shrunk, and added to that feature's
table. Then the pairs of features with the largest joint gain get tables over
two coarse binnings, boosted likewise. A score is the logistic of the sum of
looked-up entries, for whole batches at once.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, those with
the least hash of their id, so the driver holds a bounded table of numbers. A
document is held out of training where ``crc32(doc_id as text) mod 5`` is 0.
Features come from the text alone.

Cases: null texts count as empty and get a score from their (zero) features.
Repeated rows are scored each; a label that is repeated for an id counts once, two
different ones count each; of several texts with a labelled id the one with the
least features teaches. Labels that are null are not used. With no labels at all every score is 0.5, with one class near that
class. A row without an id is not held out.
Texts of any length are read whole; scores may be equal, and each row has its own. Other columns are ignored. Empty
tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick, table

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS = 48, 8
CYCLES, PAIR_CYCLES = 120, 60
RATE, RIDGE = 0.1, 1.0
PAIRS, LEAVES, LEAST_ROWS = 6, 3, 10
FEATURES = (
    "words", "word_length", "upper_words", "symbols", "shouts", "bars", "digits", "distinct_words", "stutter",
    "repeated_lines", "top_word", "odd_lines", "repeated_runs", "other_signs", "line_length", "stops",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_OTHER = np.zeros(256, bool)
_OTHER[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,#*$%&|<>!"]] = True
RUN = 5


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    counts = Counter(words)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    lines = [x for x in text.split("\n") if x.strip()]
    odd = sum(len(x) for x in lines if x.isupper() or sum(map(x.count, "#*$%&|<>!")) * 20 > len(x))
    runs = Counter(zip(*[words[i:] for i in range(RUN)], strict=False))
    again = sum(c for c in runs.values() if c > 1)
    return [
        float(np.log1p(n)), sum(len(w) * c for w, c in counts.items()) / n, upper / n, float(raw[_SYMBOL].sum()) / n, float(raw[33]) / n, float(raw[124]) / n,
        float(raw[48:58].sum()) / n, len(counts) / n, sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1),
        counts.most_common(1)[0][1] / n, odd / max(1, len(text)), again / n, float(raw[_OTHER].sum()) / n, n / max(len(lines), 1), float(raw[46]) / n,
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values of a best-first tree over ordered bins."""
    gain_of = lambda g, h: g * g / (h + RIDGE)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a < 2:
                continue
            g, h, c = (np.cumsum(x[a:b]) for x in (grad, hess, count))
            gain = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            gain[(c[:-1] < LEAST_ROWS) | (c[-1] - c[:-1] < LEAST_ROWS)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of a two-way grid into four."""
    k = len(grad)
    g, h, c = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess, count))
    best, at = 0.0, None
    for i in range(1, k):
        for j in range(1, k):
            parts = [(x[i, j], x[i, k] - x[i, j], x[k, j] - x[i, j], x[k, k] - x[i, k] - x[k, j] + x[i, j]) for x in (g, h, c)]
            if min(parts[2]) < LEAST_ROWS:
                continue
            gain = sum(a * a / (b + RIDGE) for a, b in zip(parts[0], parts[1], strict=True))
            if gain > best:
                best, at = gain, (i, j, parts)
    out = np.zeros((k, k))
    if at:
        i, j, (g4, h4, _) = at
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = (a / (b + RIDGE) for a, b in zip(g4, h4, strict=True))
    return best, out


class AdditiveModel:
    """Lookup tables; ``score`` is what executors run."""

    def __init__(self) -> None:
        self.base = 0.0
        self.cuts: list[np.ndarray] = [np.zeros(0)] * len(FEATURES)
        self.pair_cuts: list[np.ndarray] = [np.zeros(0)] * len(FEATURES)
        self.tables: list[np.ndarray] = [np.zeros(1)] * len(FEATURES)
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    @staticmethod
    def _cuts(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.arange(1, n) / n, method="lower"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        self.cuts = [self._cuts(c, BINS) for c in x.T]
        bins = [np.searchsorted(cut, c, side="left") for cut, c in zip(self.cuts, x.T, strict=True)]
        sizes = [len(c) + 1 for c in self.cuts]
        counts = [np.bincount(b, minlength=s) for b, s in zip(bins, sizes, strict=True)]
        self.tables = [np.zeros(s) for s in sizes]
        total = np.full(len(y), self.base)
        for _ in range(CYCLES):
            for f, b in enumerate(bins):
                p = 1 / (1 + np.exp(-total))
                step = RATE * _tree(np.bincount(b, y - p, sizes[f]), np.bincount(b, p * (1 - p), sizes[f]), counts[f])
                self.tables[f] += step
                total += step[b]
        self.pair_cuts = [self._cuts(c, PAIR_BINS) for c in x.T]
        coarse = [np.searchsorted(cut, c, side="left") for cut, c in zip(self.pair_cuts, x.T, strict=True)]
        grid = PAIR_BINS * PAIR_BINS
        cells = {(f, g): coarse[f] * PAIR_BINS + coarse[g] for f in range(len(bins)) for g in range(f)}
        shaped = lambda z: z.reshape(PAIR_BINS, PAIR_BINS)

        def cut(cell: np.ndarray) -> tuple[float, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return _quadrants(*(shaped(np.bincount(cell, w, grid)) for w in (y - p, p * (1 - p), None)))

        chosen = sorted(cells, key=lambda k: (-cut(cells[k])[0], k))[:PAIRS]
        tables = {k: np.zeros((PAIR_BINS, PAIR_BINS)) for k in chosen}
        for _ in range(PAIR_CYCLES):
            for k in chosen:
                step = RATE * cut(cells[k])[1]
                tables[k] += step
                total += step.ravel()[cells[k]]
        self.pairs = [(f, g, t) for (f, g), t in tables.items()]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (cut, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cut, x[:, f], side="left")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="left") for pair in self.pairs for f in pair[:2]}
        for f, g, t in self.pairs:
            total += t[coarse[f], coarse[g]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _rows(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on a bounded sample of labelled documents, the same one for the same ids."""
    known = pick(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").distinct()
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")  # at most ``rows`` ids
    # one row for each labelled id and label: at most ``rows``, whatever copies the documents hold
    found = texts.mapInArrow(run, "doc_id bigint, y double, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow()
    order = np.lexsort([found["y"].to_numpy(), found["doc_id"].to_numpy()])
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x[order], found["y"].to_numpy()[order])


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_rows(b.column(1).to_pylist())))], ["doc_id", "score"])

    scored = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit_model(docs, table(spark, sf_dir, "labels")))
