"""Near-duplicate classes by circulant MinHash with exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. Two
permutations of the 32-bit numbers make all signature coordinates: the first
scatters the hashes once, the second is read at circularly shifted places, so
coordinate ``k`` is the least ``second(first(x) - k)`` over the set. Bands of
coordinates are hashed to bucket keys; pairs out of shared buckets are verified
on the full sets, and verified links are joined to components.

Big buckets never become all their pairs. Documents with equal sets are one
class from the start. In each bucket every class is first compared with the one
class (the hub) that shares most buckets with others. The classes of a hub get a
common core, the shingles that most of them have, and are described by how they
depart from it. That alone tells that pairs with few departures are alike, so
they need one link each to the least departing class; and that any other two can
only be alike if they share a certain number of departures. Such pairs are found
through their rarest departures, bounded once more by bit masks of all their
departures, and verified. So every pair that shares a
bucket is verified, in one component, or proven too far apart, with no cap on
the size of a bucket.

With 32 bands of 5 coordinates, a pair at similarity 0.8 shares no bucket once
in 300,000 cases.

Cases: null or empty texts and texts without words have empty sets and link
with nothing (their component is their own id). Repeated rows are one class and
each comes out. Rows without an id take part and never lend their id. Other
columns are ignored. Very long texts are taken whole; only their sets are held.
Ties between representatives go to the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, documents, pick, small_batches, stored
from .components import components

BANDS, ROWS = 32, 5
#: Percent of the union that two sets must share.
PERCENT = 80
#: Pairs of one class that a task of the verification takes at most.
PAIRS_A_COPY = 256
#: 64-bit numbers of a mask of departures.
MASK_LONGS = 8
#: Rows of a batch that goes to a Python worker: a row holds up to two whole sets or a text.
BATCH_ROWS = 512
#: Word hashes that a worker keeps.
_WORDS = 200_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n if n < size else 0, np.uint64)
    for i in range(n):
        out += h[i : len(out) + i] * _MULT[i]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _mix(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(found: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Coordinates of a set that is not empty: the second permutation, shifted by 0 to n - 1 places."""
    low = _mix((found ^ (found >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, _mix(low[None, at : at + 512] - shift, 0x21F0AAAD, 0x735A2D97).min(axis=1), out=out)
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    key = (rows * _MULT[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64) * _MULT[6]
    key ^= key >> np.uint64(31)
    return (key * _MULT[7]).view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (a 128-bit name of the set; null for the empty set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                nodes.append(hashlib.md5(found).digest() if len(found) else None)
                keys.append(bucket_keys(signature(found)) if len(found) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_shingles", "node", "keys"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """name, found: the full set as 64-bit numbers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t, size) for t in batch.column(0).slice(at, 256).to_pylist()]
                found = [f for f in found if len(f)]
                nodes = [hashlib.md5(f).digest() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["name", "found"])

    return docs.select("text").mapInArrow(run, "name binary, found binary")


def _with_sets(pairs: DataFrame, sets: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b, found_a, found_b (of ``others``, or sets). A ``b`` in many pairs is copied for parts of them."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    hubs = (sets if others is None else others).join(copies.withColumnRenamed("b", "node"), "node").select(
        F.col("node").alias("b"), F.col("found").alias("found_b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    dealt = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int")).drop("copies")
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("found").alias("found_a")), "a").join(hubs, ["b", "copy"])
    return both.select("a", "b", "found_a", "found_b")


def shared_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, shared: sizes of the full sets and of what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.frombuffer(x + y, np.uint64), kind="stable")
                rows.append((len(x) // 8, len(y) // 8, int(np.count_nonzero(both[1:] == both[:-1]))))
            columns = [pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "n_a", "n_b", "shared"])

    return _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, shared bigint")


def similar(percent: int) -> str:
    return f"100 * shared >= {percent} * (n_a + n_b - shared)"


def departures(pairs: DataFrame, sets: DataFrame, cores: DataFrame) -> DataFrame:
    """a, b, size, h (of the core), lacking, added, the shingles that one of ``a`` and the core of ``b`` has, and their bit mask.

    ``slack`` departures share a bit with others of the same class, so two
    classes share at most the bits that both masks have and the lesser slack.
    """
    both = _with_sets(pairs, sets, cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, masks = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, lacking = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                parts.append(np.concatenate([added, lacking]).view(np.int64))
                mask = np.zeros(MASK_LONGS * 8, np.uint8)
                bit = np.unique((parts[-1].view(np.uint64) * _MULT[5] >> np.uint64(40)) % np.uint64(MASK_LONGS * 64)).astype(np.int64)
                np.bitwise_or.at(mask, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
                masks.append(mask.view(np.int64).tolist())
                rows.append((len(x), len(y), len(lacking), len(added), len(parts[-1]) - len(bit)))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            columns = [pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(masks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *lists], ["a", "b", "size", "h", "lacking", "added", "slack", "shingles", "mask"])

    return both.mapInArrow(run, "a bigint, b bigint, size bigint, h bigint, lacking bigint, added bigint, slack bigint, shingles array<bigint>, mask array<bigint>")


def cores_of(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """node (the hub), found: the shingles that more than half of a hub's classes have, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(flat)], ["b", "shingle"])

    held = groups.join(sets.withColumnRenamed("node", "a"), "a").select("b", "found").mapInArrow(run, "b bigint, shingle bigint")
    often = held.groupBy("b", "shingle").agg(F.count("*").alias("n"))
    members = groups.groupBy("b").agg(F.count("*").alias("members"))
    common = often.join(members, "b").filter("2 * n > members").groupBy("b").agg(F.collect_list("shingle").alias("core"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = [np.sort(np.array(x, np.int64).view(np.uint64)).tobytes() if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(core, pa.binary())], ["node", "found"])

    # a core is at most twice as large as a set of the group
    return members.join(common, "b", "left").select("b", "core").mapInArrow(packed, "node bigint, found binary")


def open_groups(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: the classes of each hub (itself among them) that has classes of several components and a pair without the hub."""
    groups = rows.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    rooted = groups.join(labels, groups["a"] == labels["node"], "left").select("a", "b", F.coalesce("root", "a").alias("root"))
    split = rooted.groupBy("b").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).filter("r0 <> r1 AND n > 2").select("b")
    return groups.join(split, "b").select("a", "b")


def core_links(described: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with the least departing one of its hub, where both depart so little that they are alike.

    Two classes that depart by weights ``c`` and share ``k`` departures are
    alike just if ``(100 + percent) * k >= c_a + c_b - (100 - percent) * h``.
    """
    least = described.groupBy("b").agg(F.min(F.struct("c", "a")).alias("low")).select("b", F.col("low.c").alias("c_low"), F.col("low.a").alias("low"))
    return described.join(least, "b").filter(f"a <> low AND c + c_low <= {100 - percent} * h").select("a", F.col("low").alias("b")).distinct()


def open_pairs(described: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes of one hub and different components that share one of their rarest departures.

    After ``core_links`` such a pair is alike only if it shares at least
    ``(c_a + c_b - (100 - percent) * h) / (100 + percent)`` departures, at least
    one. With ``d`` departures, one of the rarest ``d - least + 1`` is shared.
    """
    rooted = described.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    low = rooted.groupBy("b").agg(F.min(F.struct("c", "root")).alias("low")).select("b", F.col("low.c").alias("c_low"), F.col("low.root").alias("core_root"))
    rooted = rooted.join(low, "b")
    others = rooted.filter("root <> core_root").groupBy("b").agg(F.min("c").alias("c_other"))
    rooted = rooted.join(others, "b")  # hubs whose classes are of one component by now drop out
    facing = F.when(F.col("root") == F.col("core_root"), F.col("c_other")).otherwise(F.col("c_low"))
    need = F.greatest(F.ceil((F.col("c") + facing - (100 - percent) * F.col("h")) / (100 + percent)), F.lit(1))
    take = F.col("lacking") + F.col("added") - need + 1
    kept = rooted.withColumn("take", take).filter("take > 0").select("a", "b", "root", "size", "h", "c", "slack", "mask", "take", "shingles")
    long = kept.select("a", "b", "take", F.explode("shingles").alias("shingle"))
    often = long.groupBy("b", "shingle").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("n", "shingle"))
    rare = stored(long.join(often, ["b", "shingle"]).withColumn("rank", rank).filter("rank <= take AND n > 1").select("a", "b", "shingle"), "minhash-rare")
    rare = rare.join(kept.drop("take", "shingles"), ["a", "b"])
    one = rare.select(F.col("b").alias("hub"), "shingle", "a", "h", *[F.col(n).alias(f"{n}_a") for n in ("root", "size", "c", "slack", "mask")])
    two = rare.select(F.col("b").alias("hub"), "shingle", F.col("a").alias("b"), *[F.col(n).alias(f"{n}_b") for n in ("root", "size", "c", "slack", "mask")])
    sizes = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    shared = " + ".join(f"bit_count(mask_a[{i}] & mask_b[{i}])" for i in range(MASK_LONGS)) + " + least(slack_a, slack_b)"
    enough = f"{100 + percent} * ({shared}) >= c_a + c_b - {100 - percent} * h"
    return one.join(two, ["hub", "shingle"]).filter("root_a < root_b").filter(sizes).filter(enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, size, percent)  # all Python work is done and written when it returns


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    docs = pick(docs, "doc_id", "text")
    signed = stored(signatures(docs, size), "minhash-documents")
    classes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    # short names for the classes, fixed by writing them
    classes = stored(classes.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    # dealt by key once: both uses need all three columns, so Spark makes one exchange of it
    rows = classes.select("node", "size", F.explode("keys").alias("key")).repartition("key")
    shared = rows.groupBy("key").agg(F.count("node").alias("n"), F.max("size").alias("largest")).filter("n > 1 AND largest > 0").select("key", "n")
    rows = stored(rows.join(shared, "key"), "minhash-buckets")
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = stored(rows.join(weight, "node").select("key", "node", "size", "weight"), "minhash-buckets")

    linked = stored(classes.join(weight.select("node"), "node", "left_semi").select("node", "name", "first_id"), "minhash-linked")
    texts = docs.join(linked, docs["doc_id"].eqNullSafe(linked["first_id"]), "left_semi")
    sets = full_sets(texts, size).join(linked.select("node", "name"), "name").groupBy("node").agg(F.first("found").alias("found"))
    sets = stored(sets, "minhash-sets")

    hub = rows.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    rows = stored(rows.join(hub, "key").select("key", "node", "size", "hub"), "minhash-buckets")
    pairs = rows.select(F.col("node").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    measured = stored(shared_counts(pairs, sets), "minhash-measured")
    edges = measured.filter(similar(percent)).select("a", "b")
    labels = components(edges)
    groups = stored(open_groups(rows, labels), "minhash-groups")
    cores = stored(cores_of(groups, sets), "minhash-cores")
    described = departures(groups, sets, cores).withColumn("c", percent * F.col("added") + 100 * F.col("lacking"))
    described = stored(described, "minhash-departures")
    for find in (lambda: core_links(described, percent), lambda: open_pairs(described, labels, percent)):
        more = stored(shared_counts(stored(find(), "minhash-pairs"), sets).filter(similar(percent)).select("a", "b"), "minhash-edges")
        if not more.isEmpty():
            edges = edges.union(more)
            labels = components(edges)

    known = classes.select("name", "node", "first_id").join(labels, "node", "left").select("name", "first_id", F.coalesce("root", "node").alias("root"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = known.join(least, "root").select(F.col("name").alias("node"), "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that represent their component, with the columns of ``documents``; of rows with equal id and text one stays."""
    kept = near_duplicates(docs, size, percent).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = pick(docs, *DOC_COLUMNS)
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
    return rows.withColumn("name", F.xxhash64("text")).dropDuplicates(["doc_id", "name"]).drop("name")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)
