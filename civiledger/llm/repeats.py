"""Removal of byte strings that occur more than once in the corpus.

Every string of ``DEPTH`` bytes that starts at two places is removed at all of
them. Suffixes are compared by merging Burrows-Wheeler transforms (``bwt``), but
only where a comparison is open:

1. Each window of ``DEPTH`` bytes is named by the least hash of its ``GRAM``-byte
   grams. Windows in a row with the same least gram form a run; equal windows
   have the same gram at the same place, so a run whose gram occurs nowhere else
   holds no repeat and goes no further.
2. Runs with equal bytes are repeats as a whole; one of them goes on.
3. The distinct runs of a gram, anchored at it, are dealt to shards. Each shard is
   sorted and transformed, the transforms are merged by interleave refinement,
   and the intervals of common prefixes of ``DEPTH`` bytes are the repeats. Tasks
   take bounded chunks of whole groups.
4. A gram with more than ``GROUP_STRINGS`` distinct runs is divided exactly before
   the merge: its runs are cut into parts of 16 starts, aligned at the gram, and
   grouped by the core that all windows of a part hold; groups still too large
   are cut into parts of 4 starts, then 1, where equal cores are equal parts. So
   no group of any size is ever gathered in one task.

Documents are read by partition; gathered for one document is only what its own
length bounds.

Cases: null texts count as empty; texts under ``DEPTH`` bytes lose nothing.
Equal texts (repeated rows, too) repeat each other and lose all their bytes if
they have ``DEPTH`` or more. Other columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated
from .common import documents, pick, stored

DEPTH, GRAM = 200, 32
#: Bytes of texts that are scanned at once; longer texts go in overlapping slabs.
SLAB = 1 << 20
#: Bytes of whole groups that are merged at once, and strings of a group that one task takes without cutting them finer.
CHUNK_BYTES = 1 << 17
GROUP_STRINGS = 1024
#: Starts of the parts into which the strings of larger groups are cut, in turn.
FINER = (16, 4, 1)
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, powers of the base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(3)
    letters = rng.integers(0, 1 << 63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
    powers = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(SLAB + DEPTH + 1, np.uint64(b & (1 << 64) - 1))
        p[0] = 1
        powers.append(np.cumprod(p, dtype=np.uint64))
    return letters, *powers


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of each gram, by differences of one running sum."""
    letters, power, inverse = _tables()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * power[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the least one, the first of equals."""
    n = len(h)
    key = (h >> np.uint64(22) << np.uint64(22)) | np.arange(n, dtype=np.uint64)  # a slab has under 2**22 places
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 22) - 1)).astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins and ends."""
    texts = texts.fill_null("")
    flat = texts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def runs_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts side by side in ``raw``: (text, first start, starts, gram's distance from the first start, gram hash, run hash) of all runs."""
    slabs, held, first = [], 0, 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b - a > SLAB:
            slabs += [([i], a + at, min(b, a + at + SLAB + DEPTH - 1)) for at in range(0, b - a - DEPTH + 1, SLAB)]
            first, held = i + 1, 0
            continue
        if first < i and held + b - a > SLAB:
            slabs.append((list(range(first, i)), int(starts[first]), int(ends[i - 1])))
            first, held = i, 0
        held += b - a
        following = i + 1 == len(starts) or ends[i + 1] - starts[i + 1] > SLAB
        if following:
            slabs.append((list(range(first, i + 1)), int(starts[first]), b))
            first, held = i + 1, 0
    for members, a, b in slabs:
        part = raw[a:b]
        if len(part) < DEPTH:
            continue
        h = gram_hashes(part)
        place = least_places(h, DEPTH - GRAM + 1)
        at = np.arange(len(place))
        tops = np.minimum(ends[members], b) - a
        owner = np.searchsorted(tops, at, side="right")
        keep = at + DEPTH <= tops[np.minimum(owner, len(tops) - 1)]
        at, place, owner = at[keep], place[keep], owner[keep]
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
        count = np.diff(np.append(new, len(at)))
        begin, gram, who = at[new], place[new], owner[new]
        view = memoryview(np.ascontiguousarray(part))
        names = np.fromiter((xxhash.xxh3_64_intdigest(view[s : s + n + DEPTH - 1]) for s, n in zip(begin.tolist(), count.tolist(), strict=True)), np.uint64, len(begin))
        text = np.array(members)[who]
        yield text, begin + a - starts[text], count, gram - begin, h[gram].view(np.int64), names.view(np.int64)


_RUN = "doc_id bigint, tag bigint, first bigint, n bigint, gram_at bigint, gram bigint, run bigint"


def runs(docs: DataFrame) -> DataFrame:
    """One row a run; ``tag`` is a hash of the text, so (doc_id, tag) names a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes(batch.column(2))
            ids, tags = batch.column(0), batch.column(1)
            for text, *columns in runs_of(raw, offsets[:-1], offsets[1:]):
                text = pa.array(text)
                first, n, gram_at, gram, name = (pa.array(c, pa.int64()) for c in columns)
                yield pa.RecordBatch.from_arrays([ids.take(text), tags.take(text), first, n, gram_at, gram, name], [c.split()[0] for c in _RUN.split(", ")])

    return docs.mapInArrow(run, _RUN)


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


#: Strings that the merge compares: their group, how many it has, place in the text, place of the gram from there, whether their repeats are known.
_STRINGS = "key bigint, kinds bigint, doc_id bigint, tag bigint, at bigint, gram_at bigint, known boolean, bytes binary"
_COLUMNS = [c.split()[0] for c in _STRINGS.split(", ")]
_FOUND = "doc_id bigint, tag bigint, at bigint, n bigint"


def cut_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs, grouped by their gram."""
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "n", "gram_at", "gram", "kinds", "copies")).alias("runs"))
    texts = docs.join(lists, _same_text(docs, lists)).select(docs["doc_id"], docs["tag"], "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for doc_id, tag, text, found in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                    raw = text.encode()
                    for r in found:
                        rows.append((r["gram"], r["kinds"], doc_id, tag, r["first"], r["gram_at"], r["copies"] > 1, raw[r["first"] : r["first"] + r["n"] + DEPTH - 1]))
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)

    return texts.mapInArrow(run, _STRINGS)


def finer(strings: DataFrame, starts: int) -> tuple[DataFrame, DataFrame]:
    """Cut strings into parts of ``starts`` starts, aligned at the gram, and group those with the same core.

    All windows of a part hold its core, and equal windows lie in the same part of
    their strings, so only parts with the same core can share any. Gives what
    equal parts settle (doc_id, tag, at, n) and one string for each distinct part.
    """
    hashed = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for key, _, doc_id, tag, first, gram_at, known, raw in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    n = len(raw) - DEPTH + 1
                    for j in range((gram_at - n + 1) // starts, gram_at // starts + 1):
                        a, b = max(0, gram_at - starts * j - starts + 1), min(n - 1, gram_at - starts * j)
                        core = hashed(raw[gram_at - starts * j : gram_at - starts * j - starts + 1 + DEPTH], (key ^ j) & 0xFFFFFFFFFFFFFFFF)
                        part = raw[a : b + DEPTH]
                        rows.append((signed(core), signed(hashed(part, (a - gram_at) & 0xFFFF)), doc_id, tag, first + a, gram_at - a, known, part))
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "part", *_COLUMNS[2:]])

    parts = stored(strings.mapInArrow(run, _STRINGS.replace("kinds", "part")), "repeat-parts")
    equal = parts.groupBy("key", "part").agg(
        (F.max("known") | (F.count("*") > 1)).alias("known"), F.min(F.struct("doc_id", "tag", "at", "gram_at", "bytes")).alias("one")
    )
    equal = stored(equal, "repeat-equal-parts")
    lone = parts.filter("NOT known").drop("known")
    settled = lone.join(equal.filter("known").select("key", "part"), ["key", "part"])
    cores = equal.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    left = equal.join(cores, "key").select("key", "kinds", "one.doc_id", "one.tag", "one.at", "one.gram_at", "known", "one.bytes")
    return settled.select("doc_id", "tag", "at", (F.length("bytes") - (DEPTH - 1)).cast("bigint").alias("n")), left


def merged_repeats(strings: DataFrame) -> DataFrame:
    """doc_id, tag, at, n: repeated starts of strings that are not known yet, from whole groups, by merging transforms."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows])
        known = np.array([r[6] for r in rows])
        found = repeated([r[7] for r in rows], np.array([r[5] for r in rows]), np.unique(keys, return_inverse=True)[1], known, DEPTH)
        out = []
        for r, starts in zip(rows, found, strict=True):
            if len(starts):
                for s in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1):
                    out.append((r[2], r[3], r[4] + int(s[0]), len(s)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["doc_id", "tag", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] != last:
                    if held >= CHUNK_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                    last = r[0]
                rows.append(r)
                held += len(r[7])
        if rows:
            yield flush(rows)

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """doc_id, tag, at, n: starts of repeated windows of each text; ``docs`` has doc_id, tag, text."""
    all_runs = stored(runs(docs), "repeat-runs")
    equal = all_runs.groupBy("gram", "run").agg(F.count("*").alias("copies"))
    grams = equal.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1")
    # written first, so that the join is of two plain exchanges and Spark can split the rows of a hot gram
    grams = stored(grams.select("gram", "kinds"), "repeat-grams")
    live = stored(all_runs.join(grams, "gram"), "repeat-live")
    equal = stored(
        live.groupBy("gram", "run", "kinds").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag", "first", "n", "gram_at")).alias("one")), "repeat-equal"
    )
    many = equal.filter("copies > 1").select("gram", "run")
    found = live.join(many, ["gram", "run"]).select("doc_id", "tag", F.col("first").alias("at"), "n")

    strings = stored(cut_runs(docs, equal.filter("kinds > 1").select("one.*", "gram", "kinds", "copies")), "repeat-strings")
    for starts in FINER:
        found = found.union(merged_repeats(strings.filter(F.col("kinds") <= GROUP_STRINGS)))
        strings = strings.filter(F.col("kinds") > GROUP_STRINGS)
        if strings.isEmpty():
            return found
        settled, strings = finer(strings, starts)
        strings = stored(strings, "repeat-strings")
        found = found.union(settled)
    return found  # parts of one start are equal if they have the same core: nothing is left


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    docs = pick(docs, "doc_id", "text").withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
    found = repeated_starts(docs).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    found = stored(found, "repeat-found")
    joined = docs.join(found, _same_text(docs, found), "left").select(docs["doc_id"], "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    n = len(raw)
                    kept, removed, spans = raw, 0, 0
                    if marks:
                        out, end = [], 0
                        for a, b in sorted((m["at"], m["at"] + m["n"] + DEPTH - 1) for m in marks):
                            if a > end or not spans:
                                out.append(raw[end:a])
                                spans += 1
                                removed += b - a
                            elif b > end:
                                removed += b - end
                            end = max(end, b)
                        kept = b"".join([*out, raw[end:]])
                    rows.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                n, removed, spans, digest, kept = zip(*rows, strict=True)
                columns = [part.column(0), *[pa.array(c, pa.int64()) for c in (n, removed, spans)], pa.array(digest), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")
