"""Benchmark decontamination under an edit distance of words.

A document is contaminated by an item if some stretch of it is within
``EDITS`` of the item's words, in edits of words (normalised: lower case,
letters and digits only). CGK random walks embed edit distance into Hamming
distance: at each step the walk over a window writes the word it stands on and
stays there or moves on, as a random bit of that word and step says. Two
windows with few edits soon walk in step again, so a few sampled steps agree
often. Windows of the size of an item, from every word on, are looked up by
such samples; enough repetitions are taken for ``RECALL`` on edited copies of
the items themselves (simulated, at the full number of edits), and unedited
passages agree in all of them. Where ``MAX_REPEATS`` do not reach ``RECALL``, as
for long items, an exact search stands in for the walks: ``e`` edits leave one of
``e + 1`` pieces of an item untouched, so every place of a piece is a hit. Each
hit is verified by exact edit distance.

Windows that cannot match are passed over first: ``e`` edits leave an item of
``n`` words at least ``n - 2 - 3 e`` of its word triples, so a window with fewer
triples of any item is no match. That is a necessary condition, not a heuristic.

Items under ``SHORT`` words allow one edit at most and are always searched by
pieces: under five words these are the whole items.

The items are read in blocks of bounded size, so what a task holds does not
grow with the benchmark; each block takes one pass over the documents.

Cases: null and empty texts, and items without words, match nothing. Texts of
any length are read whole, in time in proportion to their length. An item of few
words is found wherever these words stand, so a benchmark of single words marks
most documents: leave such items out of the table if that is not wanted. Repeated documents come out each; repeated item ids count once, with
the least distance. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, documents, pick, table

#: Edits allowed for each word of an item.
EDITS = 0.2
#: Items of fewer words have no word triple that all allowed edits must leave.
SHORT = 6
RECALL = 0.99
#: Words sampled in a repetition.
SAMPLE = 3
MAX_REPEATS = 60
#: Characters of items in a block.
BLOCK_CHARS = 4_000_000
_DOCS = 1024
_SIEVE = 1 << 21
_TOKENS = 500_000
_NOT_WORD = re.compile(r"[\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return [w for w in (_NOT_WORD.sub("", t.lower()) for t in (text or "").split()) if w]


def triples(ids: np.ndarray) -> np.ndarray:
    """A number under ``_SIEVE`` for each three words in a row."""
    x = ids.astype(np.uint64)
    key = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    return ((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(43)).astype(np.int32)


def edits_of(n: int) -> int:
    return int(EDITS * n + 1e-9)


class Pattern:
    """Least edit distance of an item to any stretch of a sequence, one machine step a word (bit-parallel columns)."""

    def __init__(self, ids: list[int]):
        self.n = len(ids)
        self.places: dict[int, int] = {}
        for i, x in enumerate(ids):
            self.places[x] = self.places.get(x, 0) | 1 << i
        self.all, self.top = (1 << self.n) - 1, 1 << (self.n - 1)

    def distance(self, sequence: list[int]) -> int:
        places, full, top = self.places, self.all, self.top
        up, down, score = full, 0, self.n
        best = score
        for x in sequence:
            eq = places.get(x, 0)
            across = eq | down
            diag = (((eq & up) + up) ^ up) | eq
            plus, minus = down | ~(diag | up), up & diag
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1, minus << 1  # the first row is free: a stretch may start anywhere
            up, down = (minus | ~(across | plus)) & full, plus & across & full
            if score < best:
                best = score
        return best


class LengthClass:
    """Items of like length and their repetitions of walk and sample."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n_words: int, seed: int):
        self.items = items
        lengths = [len(x) for _, x in items]
        self.low, self.high = min(lengths), max(lengths)
        self.span = self.high + edits_of(self.high)
        self.repeats: list[tuple[np.ndarray, list[int], dict[int, list[int]], np.ndarray]] = []
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.heads = np.zeros(0, bool)
        self.short, self.recall = self.high < SHORT, 1.0
        if self.short:
            self.first_words = np.zeros(n_words + 1, bool)
            self._seed()
            return
        self.least = min(n - 2 - 3 * edits_of(n) for n in lengths)
        self.triples = np.zeros(_SIEVE, bool)
        for _, x in items:
            self.triples[triples(x)] = True
        rng = np.random.default_rng(seed)
        steps = max(SAMPLE, int(1.6 * self.low))
        flat, starts = self._flat([x for _, x in items], steps)
        copies, owner = self._edited(rng, n_words)
        edited, at = self._flat(copies, steps)
        found = np.zeros(len(copies), bool)
        while len(self.repeats) < 4 or (found.mean() < RECALL and len(self.repeats) < MAX_REPEATS):
            bits = rng.integers(0, 1 << 63, (-(-steps // 63), n_words + 1), np.int64).view(np.uint64)
            sample = sorted(rng.choice(steps, SAMPLE, replace=False).tolist())
            keys = self.keys(flat, starts, bits, sample)
            lookup: dict[int, list[int]] = {}
            for k, key in enumerate(keys.tolist()):
                lookup.setdefault(key, []).append(k)
            sieve = np.zeros(1 << 16, bool)
            sieve[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.repeats.append((bits, sample, lookup, sieve))
            found |= self.keys(edited, at, bits, sample) == keys[owner]
        self.recall = float(found.mean())
        if self.recall < RECALL:
            self._seed()

    def _seed(self) -> None:
        """Take pieces of the items in place of the walks: by size, then hash, the items and offsets that have them."""
        self.repeats = []
        self.heads = np.zeros(_SIEVE, bool)
        for k, (_, x) in enumerate(self.items):
            size = len(x) // (edits_of(len(x)) + 1)
            offsets = np.arange(edits_of(len(x)) + 1) * size
            if self.short:
                self.first_words[x[offsets]] = True
            else:
                self.heads[triples(x)[offsets]] = True
            lookup = self.pieces.setdefault(size, {})
            for offset, key in zip(offsets.tolist(), self.piece_keys(x, offsets, size).tolist(), strict=True):
                lookup.setdefault(key, []).append((k, offset))

    @staticmethod
    def piece_keys(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each start on."""
        key = np.zeros(len(starts), np.uint64)
        for j in range(size):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64) + np.uint64(1))
        return key

    def seeded(self, ids: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, place) for each place of a piece in the windows from these starts; short items' pieces anywhere."""
        if self.short:
            places = np.flatnonzero(self.first_words[ids])
        else:
            cover = np.zeros(len(grams) + 1, np.int32)
            np.add.at(cover, starts, 1)
            np.add.at(cover, np.minimum(starts + self.span, len(grams)), -1)
            places = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & self.heads[grams])
        for size, lookup in self.pieces.items():
            good = places[places + size <= len(ids)]
            for p, key in zip(good.tolist(), self.piece_keys(ids, good, size).tolist(), strict=True):
                for k, offset in lookup.get(key, ()):
                    yield k, p - offset, p

    @staticmethod
    def _flat(sequences: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
        tail = np.zeros(pad, np.int32)
        flat = np.concatenate([x for s in sequences for x in (s, tail)])
        return flat, np.cumsum([0, *(len(s) + pad for s in sequences[:-1])])

    def _edited(self, rng: np.random.Generator, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Copies of items with all edits allowed: words replaced by other ones, dropped or put in."""
        copies, owner = [], []
        for k in rng.integers(0, len(self.items), 400):
            x = self.items[k][1].tolist()
            for _ in range(edits_of(len(x))):
                kind, i = rng.integers(3), int(rng.integers(len(x)))
                other = int(rng.integers(0, n_words + 1))
                if kind == 0:
                    x[i] = other
                elif kind == 1:
                    x.insert(i, other)
                elif len(x) > 2:
                    x.pop(i)
            copies.append(np.array(x, np.int32))
            owner.append(k)
        return copies, np.array(owner)

    @staticmethod
    def keys(ids: np.ndarray, starts: np.ndarray, bits: np.ndarray, sample: list[int]) -> np.ndarray:
        """Hash of the words that the walks from these starts write at the sampled steps."""
        at, key, want = starts.copy(), np.zeros(len(starts), np.uint64), set(sample)
        for step in range(sample[-1] + 1):
            here = ids[at]
            if step in want:
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + here.astype(np.uint64) + np.uint64(1))
            at += ((bits[step // 63][here] >> np.uint64(step % 63)) & np.uint64(1)).astype(at.dtype)
        return key


class Index:
    """One block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, x in items for w in x}), 1)}
        coded = [(k, np.array([self.vocabulary[w] for w in x], np.int32)) for k, x in items]
        self.patterns = {}
        classes: dict[int, list] = {}
        for k, x in coded:
            classes.setdefault(-1 if len(x) < SHORT else int(np.log(len(x)) / np.log(1.3)), []).append((k, x))
        self.classes = [LengthClass(c, len(self.vocabulary), seed) for seed, c in sorted(classes.items())]
        self.pad = max((c.span for c in self.classes), default=0) * 2
        self.known: dict[str, int] = {}

    def code(self, text: str | None) -> list[int]:
        """Word ids of a text: 0 for words that no item has."""
        known, out = self.known, []
        tokens = (text or "").split()
        for t in set(tokens).difference(known):
            w = _NOT_WORD.sub("", t.lower())
            known[t] = self.vocabulary.get(w, 0) if w else -1
        out = list(map(known.__getitem__, tokens))
        if len(known) > _TOKENS:
            known.clear()
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item id, distance, words of the item) of every item found in each text."""
        coded = [self.code(t) for t in texts]
        ids = np.fromiter((i for c in coded for i in c), np.int32, sum(map(len, coded)))
        row = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        real = ids >= 0
        ids, row = ids[real], row[real]
        ends = np.searchsorted(row, np.arange(len(coded) + 1))
        n = len(ids)
        ids = np.concatenate([ids, np.zeros(self.pad + 1, np.int32)])
        grams = triples(ids)
        begins = np.arange(n)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for c in self.classes:
            starts = begins
            if not c.short:
                seen = np.zeros(len(grams) + 1, np.int32)
                np.cumsum(c.triples[grams], out=seen[1:])
                starts = begins[seen[begins + c.span - 2] - seen[begins] >= c.least]
            hits: set[tuple[int, int]] = set()
            if not len(starts):
                continue
            for bits, sample, lookup, sieve in c.repeats:
                keys = c.keys(ids, starts, bits, sample)
                for i in np.flatnonzero(sieve[(keys & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
                    hits.update((k, int(starts[i])) for k in lookup.get(int(keys[i]), ()))
            if c.pieces:
                # the first word of a document bounds where a passage in it starts
                hits.update((k, max(s, int(ends[row[p]]))) for k, s, p in c.seeded(ids, grams, starts) if p < n)
            last: dict[int, tuple[int, int]] = {}
            for k, s in sorted(hits):
                item, x = c.items[k]
                r, e = int(row[s]), edits_of(len(x))
                if best.get((r, item), (1, 0))[0] == 0:
                    continue
                if last.get(k, (-1, 0))[0] == r and s <= last[k][1]:
                    continue
                last[k] = (r, s + e)
                pattern = self.patterns.get((len(x), k))
                if pattern is None:
                    pattern = self.patterns[len(x), k] = Pattern(x.tolist())
                a, b = max(int(ends[r]), s - 2 * e), min(int(ends[r + 1]), s + len(x) + 3 * e)
                d = pattern.distance(ids[a:b].tolist())
                if d <= e and (d, len(x)) < best.get((r, item), (e + 1, 0)):
                    best[r, item] = (d, len(x))
        return [(r, item, d, size) for (r, item), (d, size) in sorted(best.items(), key=lambda x: x[0])]


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The items in blocks of about ``BLOCK_CHARS`` characters; each is bounded and read on its own."""
    items = pick(benchmark, "item_id", "text").filter("text IS NOT NULL").withColumn("item_id", F.col("item_id").cast("bigint"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = sorted(((r["item_id"], words(r["text"])) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        found = [x for x in found if x[1]]
        if found:
            yield Index(found)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, n_words: every item that a document holds, at its least edit distance."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, distance bigint, n_words bigint"
    out = spark.createDataFrame([], schema)
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _DOCS):
                    part = batch.slice(at, _DOCS)
                    found = index.matches(part.column(1).to_pylist())
                    if found:
                        r, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), *[pa.array(c, pa.int64()) for c in rest]], ["doc_id", "item_id", "distance", "n_words"])

        out = out.union(pick(docs, "doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns of ``documents``."""
    out = pick(docs, *DOC_COLUMNS)
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _DOCS):
                    part = batch.slice(at, _DOCS)
                    bad = {r for r, *_ in index.matches(part.column(1).to_pylist())}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
