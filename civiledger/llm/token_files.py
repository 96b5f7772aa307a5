"""Token ids in a binary format of byte or bit planes.

A shard file holds::

    magic | block ... block | documents | chunk index | footer

A block is a fixed number of ids, transposed: plane ``p`` holds byte (or bit)
``p`` of every id in turn, so that the seldom-used high bits lie together. Each
plane is compressed by zstandard on its own; planes of zeros take no bytes. The
chunk index gives each block's place, ids, checksum and plane lengths, so any
range of ids is read without the rest. ``documents`` holds doc_id and length of
each document in order.

Shards are numbered in ascending doc_id order (nulls first; ties by the text's
hash). A task writes its shard under a name of its own attempt, and the manifest
names the files of those attempts that Spark committed, so a lost executor or a
repeated task leaves stray files but no wrong ones.

Null texts count as empty: only the end id. Repeated rows are documents of
their own. A text of any length is encoded whole; readers and writers hold it
and one block. An empty table makes an empty manifest and no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import tokenizer_path, word_ids
from .common import documents, pick, scratch_path, small_batches, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"CLPLANE1"
BLOCK_IDS = 1 << 16
LEVEL = 3
SLICE = 256
#: Rows of a batch to Python: whole texts by the usual 10,000 stand in memory several times.
BATCH_ROWS = 512
MANIFEST = "shard bigint, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """Rows are planes: 4 of bytes or 32 of bits, low ones first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


class ShardWriter:
    """Writes one shard to an open binary stream, holding one block at a time."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = stream.write(MAGIC) and len(MAGIC)
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        if self.pending_bytes >= 4 * self.block_ids:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        raw, step = b"".join(self.pending), 4 * self.block_ids
        whole = len(raw) if all_ else len(raw) - len(raw) % step
        for at in range(0, whole, step):
            ids = np.frombuffer(raw[at : min(whole, at + step)], "<u4")
            sizes, place = [], self.at
            for plane in to_planes(ids, self.kind):
                data = self.pack(plane.tobytes()) if plane.any() else b""
                sizes.append(len(data))
                self._write(data)
            self.blocks.append([place, len(ids), zlib.crc32(ids.tobytes()), sizes])
        self.pending, self.pending_bytes = [raw[whole:]], len(raw) - whole

    def close(self) -> int:
        self._flush(True)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes() + known.tobytes()
        docs_at, docs = self.at, self.pack(docs)
        self._write(docs)
        index = self.pack(json.dumps({"kind": self.kind, "block_ids": self.block_ids, "n_docs": len(known), "docs": [docs_at, len(docs)], "blocks": self.blocks}).encode())
        index_at = self.at
        self._write(index)
        self._write(struct.pack("<QQ", index_at, len(index)) + MAGIC)
        return self.at


class ShardReader:
    """Reads a shard, or any range of its ids, from a seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        end = file.tell()
        tail = self._read(end - 16 - len(MAGIC), 16 + len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError("not a shard of token planes")
        at, size = struct.unpack("<QQ", tail[:16])
        self.index = json.loads(self.unpack(self._read(at, size)))
        n = self.index["n_docs"]
        docs = self.unpack(self._read(*self.index["docs"])) if n else b""
        self.lengths = np.frombuffer(docs, "<u8", n, 8 * n).astype(np.int64)
        known = np.frombuffer(docs, np.uint8, n, 16 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(docs, "<i8", n), known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum([b[1] for b in self.index["blocks"]], dtype=np.int64)])

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, k: int) -> np.ndarray:
        place, n, crc, sizes = self.index["blocks"][k]
        raw, at, planes = self._read(place, sum(sizes)), 0, []
        width = n if self.index["kind"] == "byte" else (n + 7) // 8
        for size in sizes:
            planes.append(np.frombuffer(self.unpack(raw[at : at + size]), np.uint8) if size else np.zeros(width, np.uint8))
            at += size
        ids = from_planes(np.stack(planes), n, self.index["kind"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; reads only the blocks that hold them."""
        first, last = (int(np.searchsorted(self.starts, x, side="right")) - 1 for x in (start, max(start, stop - 1)))
        if stop <= start:
            return np.zeros(0, np.uint32)
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - self.starts[first] : stop - self.starts[first]]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, holding a block and the document at hand."""
        rest, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            got = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, got[:n]
            rest = got[n:]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all texts and write them as shards under ``folder``; returns the stored manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        writer = stream = None
        n_ids = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                if writer is None:
                    uri = f"{folder}/{shard:08d}-{uuid.uuid4().hex}.planes"
                    target, name = _filesystem(uri)
                    target.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = target.open_output_stream(name)
                    writer = ShardWriter(stream, kind, block_ids)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, ids + end)
                    n_ids += len(ids) // 4 + 1
        if writer is not None:
            size = writer.close()
            stream.close()
            row = {"shard": [shard], "path": [uri], "n_docs": [len(writer.lengths)], "n_ids": [n_ids], "n_bytes": [size]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    tie = F.xxhash64("text")
    rows = pick(docs, "doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return stored(rows.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, name = _filesystem(uri)
                with source.open_input_file(name) as file:
                    rows: list[tuple] = []
                    for doc_id, ids in ShardReader(file).documents():
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.tobytes())))
                        base += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    # one row a shard: few enough for one sorted pass
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "shard").select("path", "base").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), folder, tokenizer_path(VOCABULARY), END_ID)
    return read_token_files(manifest)
