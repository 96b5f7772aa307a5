"""Best-fit packing of token pieces into sequences by linear grouping.

Lengths are integers up to the capacity, so a histogram of at most that many
rows says all about the corpus that a packing needs. On it:

1. large lengths, in descending order, fall into groups of equal cardinality,
   each rounded up to its largest member;
2. a linear programme over configurations (which few sizes share a sequence) is
   solved by column generation, and rounded down;
3. the documents' own lengths take the places of the rounded ones;
4. what is left of the large lengths, then the small ones, go best-fit,
   longest first, into the sequence with the least sufficient room.

The plan lists ranges of ranks within each length; documents get their ranks by
salted counting, so that a length that a third of the pieces share is no single
task. Only the histogram and the plan, both bounded by the capacity, reach the
driver.

Null texts count as empty (the end id alone). Repeated rows are packed as often
as they occur; of pieces of equal length any may take a place. A text of any
length is encoded whole and cut into full pieces. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_path, word_ids
from .common import documents, pick, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 0
CAPACITY = 2048
#: Lengths above capacity / LARGE_PART are large.
LARGE_PART = 8
GROUPS = 96
SLICE = 256


@dataclass
class Segment:
    """``n`` sequences filled alike: slots (length, first rank, pieces a sequence) in order."""

    n: int
    room: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, k: int) -> Segment:
        """Leave the first ``k`` sequences here; return the others."""
        other = Segment(self.n - k, self.room, [(size, rank + k * q, q) for size, rank, q in self.slots])
        self.n = k
        return other


def best_pattern(worth: np.ndarray, place: np.ndarray, most: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of at most ``most`` sizes within the capacity.

    ``place[i, c]``: the room that size ``i`` leaves of ``c``, or the last place, which holds no value.
    """
    best = np.append(np.zeros(place.shape[1]), -np.inf)
    taken = []
    for _ in range(most):
        value = best[place] + worth[:, None]
        k = value.argmax(axis=0)
        top = value[k, np.arange(place.shape[1])]
        better = top > best[:-1] + 1e-12
        taken.append(np.where(better, k, -1))
        best = np.append(np.where(better, top, best[:-1]), -np.inf)
    count, room = np.zeros(len(worth)), place.shape[1] - 1
    for layer in reversed(taken):
        if layer[room] >= 0:
            count[layer[room]] += 1
            room = int(place[layer[room], room])
    return float(best[-2]), count


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each: revised simplex, columns made as they are needed."""
    k = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    place = np.arange(capacity + 1)[None, :] - sizes[:, None]
    place[place < 0] = capacity + 1
    most = capacity // int(sizes.min())
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        value, column = best_pattern(np.maximum(price, 0), place, most)
        if value <= 1 + 1e-7:
            break
        x, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.inv(basis) @ demand
    return [(basis[:, j], max(0.0, float(x[j]))) for j in range(k)]


def best_fit(segments: dict[int, list[Segment]], rooms: list[int], size: int, rank: int, count: int, capacity: int) -> None:
    """Put ``count`` pieces of one size, ranks from ``rank`` on, where they leave least room."""

    def put(seg: Segment) -> None:
        if seg.room not in segments or not segments[seg.room]:
            if seg.room not in segments:
                segments[seg.room] = []
            at = bisect_left(rooms, seg.room)
            if at == len(rooms) or rooms[at] != seg.room:
                rooms.insert(at, seg.room)
        segments[seg.room].append(seg)

    while count:
        at = bisect_left(rooms, size)
        if at == len(rooms):
            q = capacity // size
            put(Segment(-(-count // q), capacity))
            continue
        room = rooms[at]
        seg = segments[room].pop()
        if not segments[room]:
            rooms.pop(at)
        q = room // size
        whole = count // q
        if whole >= seg.n:
            each, used = q, seg.n
        elif whole:
            each, used = q, whole
        else:
            each, used = count, 1
        if used < seg.n:
            put(seg.split(used))
        seg.slots.append((size, rank, each))
        seg.room -= each * size
        rank, count = rank + used * each, count - used * each
        put(seg)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Segment], dict]:
    """Segments that hold every piece of the histogram {length: count} once."""
    done: list[Segment] = []
    pool: dict[int, list[Segment]] = {}
    rooms: list[int] = []
    rank = dict.fromkeys(histogram, 0)
    left = dict(histogram)
    if left.get(capacity):
        done.append(Segment(left[capacity], 0, [(capacity, 0, 1)]))
        left[capacity] = 0
    large = sorted((s for s in left if capacity // LARGE_PART < s < capacity and left[s]), reverse=True)
    n_large = sum(left[s] for s in large)
    planned = 0.0
    if n_large:
        # groups of equal cardinality; each is a list of runs [length, count], longest first
        each, runs = -(-n_large // groups), [[]]
        free = each
        for s in large:
            c = left[s]
            while c:
                if not free:
                    runs.append([])
                    free = each
                n = min(c, free)
                runs[-1].append([s, n])
                c, free = c - n, free - n
        sizes = np.array([r[0][0] for r in runs])
        demand = np.array([sum(n for _, n in r) for r in runs], float)
        for pattern, times in solve_configurations(sizes, demand, capacity):
            planned += times
            n = int(times + 1e-6)
            if not n:
                continue
            todo = [Segment(n, capacity)]
            for g in np.repeat(np.arange(len(sizes)), pattern.astype(int)):
                # put the group's next pieces, one a sequence, splitting where their length changes
                later = []
                for seg in todo:
                    while seg is not None and runs[g]:
                        s, c = runs[g][0]
                        rest = seg.split(c) if c < seg.n else None
                        seg.slots.append((s, rank[s], 1))
                        seg.room -= s
                        rank[s] += seg.n
                        left[s] -= seg.n
                        if seg.n == c:
                            runs[g].pop(0)
                        else:
                            runs[g][0][1] -= seg.n
                        later.append(seg)
                        seg = rest
                    if seg is not None:
                        later.append(seg)
                todo = later
            for seg in todo:
                pool.setdefault(seg.room, []).append(seg)
        rooms = sorted(pool)
    for s in sorted(left, reverse=True):
        if left[s]:
            best_fit(pool, rooms, s, rank[s], left[s], capacity)
    done += [seg for r in sorted(pool) for seg in pool[r] if seg.slots]
    total = sum(s * c for s, c in histogram.items())
    return done, {"sequences": sum(s.n for s in done), "bound": -(-total // capacity), "planned": planned}


def plan_rows(segments: list[Segment]) -> dict[str, np.ndarray]:
    """Columns, ordered by length and rank: pieces of ``length`` from ``rank`` on lie ``each`` to a sequence from ``seq`` at ``offset``."""
    rows, seq = [], 0
    for seg in segments:
        offset = 0
        for size, rank, each in seg.slots:
            rows.append((size, rank, each, seq, offset))
            offset += size * each
        seq += seg.n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "seq", "offset"), table.T, strict=True))


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut where they exceed the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = word_ids(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), step)):
                        cut = ids[a : a + step]
                        rows.append((doc_id, k, a // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")
    return cut.withColumn("piece", F.col("piece").cast("int"))


def pack(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = pieces(docs, path, end_id, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    cut = stored(cut, "pieces")
    counts = stored(cut.groupBy("length", "salt").count(), "piece-counts")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    segments, _ = plan_packing(histogram, capacity, groups)
    plan = plan_rows(segments)

    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(bases, ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(plan["rank"].max(initial=0)) + 1
        span = max(span, max(histogram.values(), default=0)) + 1
        keys = plan["length"] * span + plan["rank"]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            far = rank - plan["rank"][at]
            seq = plan["seq"][at] + far // plan["each"][at]
            offset = plan["offset"][at] + far % plan["each"][at] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(VOCABULARY))
