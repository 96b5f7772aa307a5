"""A kept search index: postings in immutable segments, tombstones, compaction and a readiness probe.

A segment holds the postings (term, doc, tf, doc_length) of the documents of
one write, in folders by bucket, and the documents' lengths. The bucket is a hash of a
term's first letters, so a term, or a prefix of that many letters, is in one
bucket; inside, terms are sorted, so Parquet's bounds skip the rest. A change of a
document is a tombstone for all earlier segments and a posting in a new one;
deletion is a tombstone alone. A search reads the buckets of its terms and takes out
what a tombstone hides; it tokenises nothing. Counts of documents and their summed
length are kept in the manifest with each write, for the formula's averages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Manifests
from .search import K1, B, postings

POSTINGS = "term string, doc bigint, tf bigint, doc_length bigint"
LENGTHS = "doc bigint, doc_length bigint"
LEAD = 2


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.buckets, self.files = spark, buckets, Manifests(spark, root)

    # state

    def _state(self) -> tuple[int, dict]:
        number, manifest = self.files.current()
        return number, manifest or {"segments": [], "tombstones": [], "docs": 0, "length": 0, "next": 1}

    def size(self) -> tuple[int, float]:
        """Live documents with any word, and their mean number of words."""
        state = self._state()[1]
        return state["docs"], state["length"] / state["docs"] if state["docs"] else 1.0

    def _buckets(self, words: list[str]) -> set[int]:
        return set(self.spark.range(1).select(F.array(*[self._bucket_of(F.lit(w)) for w in words])).first()[0])

    def _bucket_of(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring(term, 1, LEAD)), F.lit(self.buckets)).cast("int")

    def _read(self, state: dict, part: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        """Rows of all segments with the number of their segment, less what tombstones hide."""
        frames = []
        for s in state["segments"]:
            folders = [f"{s[part]}/_bucket={b}" for b in s["buckets"] if b in buckets] if buckets is not None else [s[part]]
            if folders:
                read = self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{f}" for f in folders])
                frames.append(read.withColumn("segment", F.lit(s["number"])))
        if not frames:
            return self.spark.createDataFrame([], schema + ", segment int")
        rows = reduce(DataFrame.unionByName, frames)
        hidden = [self.spark.read.schema("doc bigint").parquet(f"{self.files.root}/{t['folder']}").withColumn("before", F.lit(t["before"])) for t in state["tombstones"]]
        if not hidden:
            return rows
        last = reduce(DataFrame.unionByName, hidden).groupBy("doc").agg(F.max("before").alias("before"))
        return rows.join(last, "doc", "left").filter(F.col("before").isNull() | (F.col("segment") >= F.col("before"))).drop("before")

    # writing

    def _segment(self, rows: DataFrame, lengths: DataFrame, number: int) -> dict:
        folder, beside = self.files.folder(), self.files.folder()
        dealt = rows.withColumn("_bucket", self._bucket_of(F.col("term"))).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "term", "doc")
        dealt.write.partitionBy("_bucket").parquet(f"{self.files.root}/{folder}")
        lengths.write.parquet(f"{self.files.root}/{beside}")
        buckets = sorted(int(n.partition("=")[2]) for n in self.files.listed(folder) if n.startswith("_bucket="))
        return {"postings": folder, "lengths": beside, "number": number, "buckets": buckets}

    def _lengths(self, folder: str) -> DataFrame:
        return self.spark.read.schema(LENGTHS).parquet(f"{self.files.root}/{folder}")

    def _hide(self, state: dict, docs: DataFrame, before: int) -> dict:
        """The state with a tombstone for the documents in all segments under ``before``, which leave the counts."""
        folder = self.files.folder()
        docs.select(F.col("doc").cast("bigint")).distinct().write.parquet(f"{self.files.root}/{folder}")
        gone = self._read(state, "lengths", LENGTHS).join(self.spark.read.schema("doc bigint").parquet(f"{self.files.root}/{folder}"), "doc", "left_semi")
        n, length = gone.agg(F.count("*"), F.coalesce(F.sum("doc_length"), F.lit(0))).first()
        return state | {"tombstones": [*state["tombstones"], {"folder": folder, "before": before}], "docs": state["docs"] - n, "length": state["length"] - length}

    def _add(self, state: dict, docs: DataFrame, key: str, text: str) -> dict:
        words = postings(docs, key, text).select(*[n.split()[0] for n in POSTINGS.split(", ")]).persist()
        try:
            segment = self._segment(words, words.select("doc", "doc_length").distinct(), state["next"])
        finally:
            words.unpersist()
        n, length = self._lengths(segment["lengths"]).agg(F.count("*"), F.coalesce(F.sum("doc_length"), F.lit(0))).first()
        return state | {"segments": [*state["segments"], segment], "next": state["next"] + 1, "docs": state["docs"] + n, "length": state["length"] + length}

    def upsert(self, docs: DataFrame, key: str, text: str) -> None:
        """Index new documents and changed ones anew; each key once in ``docs``."""
        number, state = self._state()
        if state["segments"]:
            state = self._hide(state, docs.select(F.col(key).alias("doc")), state["next"])
        self.files.commit(number + 1, self._add(state, docs, key, text))

    def delete(self, docs: DataFrame, key: str) -> None:
        number, state = self._state()
        self.files.commit(number + 1, self._hide(state, docs.select(F.col(key).alias("doc")), state["next"]))

    def rebuild(self, docs: DataFrame, key: str, text: str) -> None:
        """All anew; searches see the old index until it is done."""
        number, state = self._state()
        self.files.commit(number + 1, self._add({"segments": [], "tombstones": [], "docs": 0, "length": 0, "next": state["next"]}, docs, key, text))

    def compact(self, keep: int = 1) -> None:
        """One segment without what tombstones hide; then old data goes."""
        number, state = self._state()
        if len(state["segments"]) > 1 or state["tombstones"]:
            live = self._read(state, "postings", POSTINGS).drop("segment").select(*[n.split()[0] for n in POSTINGS.split(", ")])
            one = self._segment(live, self._read(state, "lengths", LENGTHS).select("doc", "doc_length"), state["next"])
            self.files.commit(number + 1, state | {"segments": [one], "tombstones": [], "next": state["next"] + 1})
        self.files.vacuum(keep)

    # reading

    def ready(self, probes: list[str]) -> bool:
        """Whether a search for any of these usual words finds something."""
        return bool(probes) and not self.terms(probes).isEmpty()

    def ensure(self, docs: DataFrame, key: str, text: str, probes: list[str]) -> bool:
        """Build the index if it is not ready; says whether it was built."""
        if self.ready(probes):
            return False
        self.rebuild(docs, key, text)
        return True

    def terms(self, terms: list[str]) -> DataFrame:
        """Live postings of these terms."""
        state, wanted = self._state()[1], sorted(set(terms))
        return self._read(state, "postings", POSTINGS, self._buckets(wanted) if wanted else set()).filter(F.col("term").isin(*wanted))

    def prefixed(self, prefixes: list[str]) -> DataFrame:
        """Live postings of the terms that begin so, with ``i``, the places of the prefixes (eight at most)."""
        if not 1 <= len(prefixes) <= 8:
            raise ValueError("a search takes one to eight prefixes")
        state = self._state()[1]
        buckets = set(range(self.buckets)) if any(len(p) < LEAD for p in prefixes) else self._buckets(prefixes)
        rows = self._read(state, "postings", POSTINGS, buckets)
        begins = reduce(Column.__or__, [F.col("term").startswith(p) for p in prefixes])
        places = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]))
        return rows.filter(begins).withColumn("i", places)

    def vocabulary(self) -> DataFrame:
        """term, df, n of all live terms."""
        rows = self._read(self._state()[1], "postings", POSTINGS, set(range(self.buckets)))
        return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))

    def _scores(self, hits: DataFrame) -> DataFrame:
        n, average = self.size()
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / F.lit(average)))
        return hits.join(df, "term").withColumn("part", part)

    def bm25(self, terms: list[str]) -> DataFrame:
        """doc, score over the documents with any of the terms."""
        return self._scores(self.terms(terms)).groupBy("doc").agg(F.sum("part").alias("score"))

    def prefix_and(self, prefixes: list[str]) -> DataFrame:
        """doc, hits, score of the documents that hold a word for each prefix."""
        rows = self._scores(self.prefixed(prefixes))
        all_ = rows.groupBy("doc").agg(F.sum("tf").alias("hits"), F.sum("part").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_set("i")))).alias("n"))
        return all_.filter(F.col("n") == len(prefixes)).drop("n")
