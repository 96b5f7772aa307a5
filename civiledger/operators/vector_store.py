"""A kept store of text pieces with vectors: checked on the way in, replaced by document, searched by vector or by words.

Each piece has its norm and a symmetric 8-bit form stored beside it, so a search
computes neither. Pieces lie in buckets of their document, so replacing or deleting
documents rewrites theirs alone; the words are in a kept text index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_lower
from ..sources.versions import BucketedTable
from .search import dot, norm, quantised
from .text_index import TextIndex

PIECES = "id bigint, doc bigint, url string, text string, vector array<double>, norm double, form array<int>, top double"
INPUT = ("id", "doc", "url", "text", "vector")


def checked(pieces: DataFrame, dims: int) -> DataFrame:
    """Adds ``refused``: null for a good piece, else what is wrong with its address or vector."""
    v = F.col("vector")
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    reason = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "address")
        .when(F.coalesce(F.size(v), F.lit(-1)) != dims, "length")
        .when(broken, "not finite")
        .when(F.forall(v, lambda x: x == 0), "zero")
    )
    return pieces.withColumn("refused", reason)


class Refused(ValueError):
    """A piece that the store does not take."""


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, dims: int, buckets: int = 16):
        self.dims = dims
        self.table = BucketedTable(spark, f"{root}/pieces", PIECES, ["doc"], buckets)
        self.words = TextIndex(spark, f"{root}/words", buckets)

    def _ready(self, pieces: DataFrame) -> DataFrame:
        rows = checked(pieces.select(*INPUT), self.dims)
        bad = rows.filter("refused IS NOT NULL").select("id", "refused").first()
        if bad:
            raise Refused(f"piece {bad['id']}: {bad['refused']}")
        v = F.transform("vector", lambda x: x.cast("double"))
        rows = rows.select("id", "doc", "url", "text", v.alias("vector"))
        return rows.select("*", norm(F.col("vector")).alias("norm"), quantised(F.col("vector")).alias("form"), F.array_max(F.transform("vector", F.abs)).alias("top"))

    def replace_documents(self, pieces: DataFrame) -> None:
        """All pieces of the documents in ``pieces`` are exchanged; nothing is where one of the new ones is refused."""
        new = self._ready(pieces).persist()
        try:
            old = self.table.read().join(new.select("doc").distinct(), "doc", "left_semi").select("id")
            gone = old.join(new.select("id"), "id", "left_anti").persist()
            gone.count()
            self.table.merge(new, lambda before, batch: before.join(batch.select("doc").distinct(), "doc", "left_anti").select(*batch.columns).unionByName(batch))
            self.words.upsert(new, "id", "text")
            self.words.delete(gone, "id")
            gone.unpersist()
        finally:
            new.unpersist()

    def delete_documents(self, docs: DataFrame) -> None:
        """``docs`` has the column doc."""
        keys = docs.select(F.col("doc").cast("bigint")).distinct().persist()
        try:
            gone = self.table.read().join(keys, "doc", "left_semi").select("id").persist()
            gone.count()
            self.table.merge(keys, lambda before, batch: before.join(batch, "doc", "left_anti").select(*before.columns))
            self.words.delete(gone, "id")
            gone.unpersist()
        finally:
            keys.unpersist()

    def count(self) -> int:
        return self.table.read().count()

    def _query(self, vector: list[float]) -> tuple[Column, float]:
        if len(vector) != self.dims or not all(map(math.isfinite, vector)):
            raise Refused("the query's vector")
        return F.array(*[F.lit(float(x)) for x in vector]), math.sqrt(sum(x * x for x in vector))

    def _scored(self, rows: DataFrame, vector: list[float]) -> DataFrame:
        q, length = self._query(vector)
        return rows.select("id", "doc", (dot(F.col("vector"), q) / (F.col("norm") * F.lit(length)) if length else F.lit(0.0)).alias("score"))

    def search(self, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        """id, doc, score of the nearest pieces by cosine, after any filter; none for a zero vector; ties by id."""
        rows = self.table.read() if where is None else self.table.read().filter(where)
        if not any(vector):
            rows = rows.limit(0)
        return self._scored(rows, vector).orderBy(F.desc("score"), "id").limit(k)

    def search_words(self, words: str, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
        """id, doc, score of the ``k`` pieces that the words find first; their score is the cosine, zero for a zero vector."""
        from ..functions.keys import search_terms

        rows = self.table.read() if where is None else self.table.read().filter(where)
        found = self.words.bm25(search_terms(words)).select(F.col("doc").alias("id"), F.round("score", 9).alias("lexical"))
        best = rows.join(found, "id").orderBy(F.desc("lexical"), "id").limit(k)
        return self._scored(best, vector)


STOP_WORDS = "a o as os um uma de da do das dos em no na nos nas para por com que e ou se foi ao aos qual quem quais".split()


def hashed_embedding(texts: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """key, vector: words counted at their FNV-1a hash modulo ``dims``, at length one; texts without words are left out.

    Words are counted before they are hashed, and a text hands on ``dims`` numbers at most.
    """
    words = texts.select(key, F.explode(F.split(fold_lower(F.col(text)), "[^a-z0-9]+")).alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(STOP_WORDS))
    h = F.aggregate(F.split("word", ""), F.lit(2166136261).cast("bigint"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(0xFFFFFFFF)))
    cells = words.groupBy(key, "word").agg(F.count("*").alias("n")).groupBy(key, F.pmod(h, F.lit(dims)).cast("int").alias("at")).agg(F.sum("n").cast("double").alias("n"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("cells"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)) / F.col("length"))
    return rows.select(key, vector.alias("vector"))
