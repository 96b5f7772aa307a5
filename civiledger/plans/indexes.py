"""The kept search indexes of a session's corpora, and queries of their maintenance."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text_index import TextIndex
from ..sources.scratch import scratch_path, scratch_root
from ..sources.tables import table
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
#: Corpus: table, key, text and usual words that any index of it holds.
CORPORA = {
    "documents": ("documents", "doc_id", "text", ["the", "der", "les", "que", "of"]),
    "parts": ("part", "p_partkey", "concat_ws(' ', p_name, p_brand, p_type)", ["part", "brand", "small", "large", "standard"]),
    "suppliers": ("supplier", "s_suppkey", "s_name", ["supplier", "supp"]),
}


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """key and text of a corpus."""
    source, key, text, _ = CORPORA[name]
    return table(spark, sf_dir, source).select(F.col(key).cast("bigint").alias("key"), F.expr(text).alias("text"))


def kept_index(spark: SparkSession, sf_dir: str, name: str = "documents") -> TextIndex:
    """The corpus' index; built when a session first asks for it and it is not ready."""
    index = TextIndex(spark, f"{scratch_root(spark)}/index-{name}-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}")
    known = spark.__dict__.setdefault("_civiledger_indexes", set())
    if index.files.root not in known:
        index.ensure(corpus(spark, sf_dir, name), "key", "text", CORPORA[name][3])
        known.add(index.files.root)
    return index


_WORDS = "list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')"


@_R.add(f"""
WITH now AS (SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN text || ' zebra ando' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
words AS (SELECT doc, unnest({_WORDS}) AS term FROM now), tf AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY ALL),
idx AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY doc) AS BIGINT) AS doc_length FROM tf), size AS (SELECT count(*) AS n, avg(doc_length) AS a FROM (SELECT DISTINCT doc, doc_length FROM idx)),
hit AS (SELECT * FROM idx WHERE term IN ('zebra', 'ando', 'ment', 'thing')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_length / a))) AS score FROM hit JOIN df USING (term), size GROUP BY doc)
SELECT doc, round(score, 6) AS score FROM bm""")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after two writes, changes of a fifth of the documents and the deletion of a seventh."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = TextIndex(spark, scratch_path(spark, "index"))
    index.rebuild(docs.filter("doc_id % 3 > 0"), "doc_id", "text")
    index.upsert(docs.filter("doc_id % 3 = 0"), "doc_id", "text")
    index.upsert(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" zebra ando"))), "doc_id", "text")
    index.delete(docs.filter("doc_id % 7 = 0"), "doc_id")
    return index.bm25(["zebra", "ando", "ment", "thing"]).select("doc", F.round("score", 6).alias("score"))


@_R.add(f"""
WITH now AS (SELECT doc_id AS doc, CASE WHEN doc_id % 4 = 0 THEN 'gone ' || lang ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({_WORDS}) AS term FROM now) GROUP BY ALL) GROUP BY term""")
def compacted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of one segment that is left of three writes and a deletion."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = TextIndex(spark, scratch_path(spark, "index"))
    index.upsert(docs, "doc_id", "text")
    index.delete(docs.filter("doc_id % 9 = 0"), "doc_id")
    index.upsert(docs.filter("doc_id % 4 = 0 AND doc_id % 9 > 0").withColumn("text", F.concat(F.lit("gone "), "lang")), "doc_id", "text")
    index.compact()
    return index.vocabulary()
