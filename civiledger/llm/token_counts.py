"""Token counts by prefix dynamic programming.

``prefix_counts`` keeps, for each document, the exact number of tokens of every
prefix of its text. Truncation and budget questions read that table: nothing is
encoded again.

Null texts count as empty: no bytes, no tokens. Rows are never merged, so
repeated rows come out as often as they came in; other columns are ignored.
Texts of any length are counted whole, unit by unit. A count of exactly the limit
is not over it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import prefix_counts as table_of
from .bpe import tokenizer_path
from .common import documents, pick

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Texts handled at once by a task.
SLICE = 256


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, counts: 32-bit little-endian token counts at the end of each UTF-8 byte of the text.

    Entry ``i`` answers for the prefix of ``i + 1`` bytes, exactly so where a character ends there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                counts = [table.prefixes(t).astype("<i4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.binary())], ["doc_id", "counts"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, counts binary")


def fitting(counts: np.ndarray, unit: str, budget: int) -> int:
    """Bytes of the longest prefix of whole characters of a unit within a budget of tokens."""
    raw = np.frombuffer(unit.encode(), np.uint8)
    ends = np.append((raw[1:] & 0xC0) != 0x80, True)
    good = np.flatnonzero(ends & (counts <= budget))
    return int(good[-1]) + 1 if len(good) else 0


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes.

    Each text's prefix table is kept at the ends of its units; the last entry is
    its token count. ``fit_bytes`` is where to truncate it: the last unit end
    within ``limit`` tokens, and from there on the byte table of the one unit
    that the limit falls in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                n_bytes, n_tokens, fit = [], [], []
                for text, (units, tokens) in zip(texts, table.unit_ends(texts), strict=True):
                    total, size = sum(tokens), len((text or "").encode())
                    n_bytes.append(size)
                    n_tokens.append(total)
                    if total > limit:
                        ends = np.cumsum(tokens)
                        k = int(np.searchsorted(ends, limit, side="right"))
                        size = len("".join(units[:k]).encode())
                        size += fitting(table.unit(units[k]), units[k], limit - (int(ends[k - 1]) if k else 0))
                    fit.append(size)
                out = [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fit, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_tokens", "fit_bytes"])

    out = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, fit_bytes bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_bytes")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path(VOCABULARY), TOKEN_LIMIT)
