"""Importance resampling of documents towards a target distribution.

Documents and target texts are bags of hashed word n-grams. A bucket's gain is
how much likelier the target is to hold it than the documents are, a document's
weight the floored mean of its features' gains, and a draw without replacement
takes the highest sums of weight and Gumbel noise from the hash of the id.

Hashing goes through an integer word dictionary: each block of texts maps its
distinct words to ids, n-grams are tuples of ids, each distinct tuple's bytes
are put together and hashed once, and the counts are joined back by position. A
block is a bounded number of bytes (but at least one text), so a task holds one
block's dictionary; one dictionary for all would shuffle every word of the
corpus. What goes from a task to the next is one count for each bucket.

Ranks come from a range partitioning by score and id: rows are numbered within
their range, and ranges by what lies before them, so no task sees all rows.

Cases: a null text has no words, hence no features, weight 0 and no rank. A null
id is hashed like the empty string and ranks before all others of its score.
Repeated rows count and are drawn each, in any order among themselves. A very
long text is a block of its own. Without any target text (or document) its
totals are 0, and the gains follow from the formula. Other columns are ignored, or
carried along on request. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pick, stored, table

BUCKETS = 10_000
LONGEST = 2
PERCENT = 25
MIN_WORDS = 20
SEED = 7
#: Bytes of text that one dictionary serves.
BLOCK_BYTES = 8 << 20
#: A-Z become a-z, digits, a-z and bytes from 80 on stay, all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def hashed(texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each n the texts and buckets of all n-grams."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    signs = np.frombuffer(b" ".join(raw).translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], signs != 32, [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    letters, places = signs[inside[1:-1]], np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    k, (_, bounds, text) = len(words.dictionary), words.dictionary.buffers()
    bounds, text = np.frombuffer(bounds, np.int64, k + 1).tolist() if k else [0], text.to_pybytes() if k else b""
    spelled = [text[a:b] for a, b in pairwise(bounds)]
    # checksums of the distinct tuples; the checksum of a tuple goes on from that of its first words
    sums = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
    out, tuples, at = [(owner, sums[ids] % buckets)], ids, np.arange(len(ids))
    tails = [b" " + w for w in spelled]
    for n in range(2, longest + 1):
        ends = at + n - 1
        whole = ends < len(ids)
        whole[whole] = owner[at[whole]] == owner[ends[whole]]
        at = at[whole]
        pairs, back = np.unique(tuples[whole] * len(spelled) + ids[at + n - 1], return_inverse=True)
        first, last = np.divmod(pairs, max(len(spelled), 1))
        sums = np.fromiter(map(zlib.crc32, map(tails.__getitem__, last.tolist()), sums[first].tolist()), np.int64, len(pairs))
        tuples = back
        out.append((owner[at], sums[back] % buckets))
    return sizes, out


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``BLOCK_BYTES`` of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows' ``text`` fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for block in _blocks(batches, 0):
            for _, found in hashed(block.column(0).to_pylist(), longest, buckets)[1]:
                total += np.bincount(found, minlength=buckets)
        (seen,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in pick(texts, "text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of each bucket's smoothed shares in the target and the corpus."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, *carry: str) -> DataFrame:
    """doc_id, the columns to carry, n_words, n_features and weight of each document."""
    names = list(dict.fromkeys(("doc_id", "text", *carry)))
    rows = pick(docs, *names)
    kept = [n for n in names if n != "text" or "text" in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            n = block.num_rows
            words, grams = hashed(block.column(1).to_pylist(), longest, len(gain))
            features, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for owner, found in grams:
                features += np.bincount(owner, minlength=n)
                before = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.searchsorted(owner, np.arange(n + 1))
                total += before[ends[1:]] - before[ends[:-1]]
            columns = [block.column(names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(features), pa.array(total // np.maximum(features, 1))], [*kept, "n_words", "n_features", "weight"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]
    return rows.mapInArrow(run, ", ".join([*kinds, "n_words bigint", "n_features bigint", "weight bigint"]))


def ranked(rows: DataFrame, eligible, most: int) -> DataFrame:
    """Add ``rank``: 1 to ``most`` among the eligible rows by falling score, then rising doc_id; null for all others."""
    by = [F.desc("score"), F.asc("doc_id"), F.asc("tie")]
    # the tie parts repeated rows, which would else all go to one range
    placed = rows.filter(eligible).withColumn("tie", F.rand(SEED)).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed.select(*rows.columns, F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("nth")), "ranges")
    # one row a range
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("nth") + 1
    drawn = placed.join(F.broadcast(sizes), "part").select(*rows.columns, F.when(rank <= most, rank).alias("rank"))
    return drawn.unionByName(rows.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, *carry: str, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document, and the columns to carry.

    ``percent`` of the documents with at least ``min_words`` words are drawn and have a rank.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    noise = f"floor(-1000 * ln(-ln((CAST(conv(substr(sha2(concat('{int(seed)}:', coalesce(CAST(doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS BIGINT) + 0.5D) / 4294967296D)))"
    rows = stored(weighed(docs, gain, longest, *carry).withColumn("score", F.col("weight") + F.expr(noise)), "weights")
    eligible = F.col("n_words") >= min_words
    return ranked(rows, eligible, percent * rows.filter(eligible).count() // 100)


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that the draw takes, with the columns of ``documents``."""
    return resample(docs, target, "text", "lang", "source", "n_chars", **how).filter("rank IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def _oracle() -> str:
    """The same by plain counts of spelled n-grams; the checksum goes byte by byte through its usual table."""
    table_ = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table_.append(i)
    split = lambda t: rf"""
      SELECT *, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {t}"""  # noqa: E731
    grams = lambda t: f"""
      SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM {t}"""  # noqa: E731
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents), items AS (SELECT row_number() OVER () AS row_id, text FROM benchmark),
doc_words AS ({split("docs")}), item_words AS ({split("items")}),
doc_grams AS ({grams("doc_words")}), item_grams AS ({grams("item_words")}),
spelled AS (SELECT DISTINCT gram FROM (SELECT gram FROM doc_grams UNION ALL SELECT gram FROM item_grams)),
bytes AS (SELECT gram, hex(encode(gram)) AS h FROM spelled),
sums AS (SELECT gram, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)),
  lambda c, b: xor(c >> 8, ({table_}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM bytes),
s AS (SELECT bucket, count(*) AS n FROM doc_grams JOIN sums USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM item_grams JOIN sums USING (gram) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM doc_grams) AS s_all, (SELECT count(*) FROM item_grams) AS t_all),
gain AS (SELECT b.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket, totals),
means AS (SELECT row_id, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM doc_grams JOIN sums USING (gram) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN means USING (row_id)),
placed AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) END AS place,
  count(*) FILTER (WHERE n_words >= {MIN_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS "rank" FROM placed
"""


ORACLE = _oracle()
