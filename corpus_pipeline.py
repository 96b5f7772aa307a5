"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage gets what the one before it has kept, written as Parquet and read
again, so a lost executor costs no earlier stage.

Cases: null and empty texts fail the quality rules and go with them. A null id is kept
and never lends itself to others; of repeated rows one stays from the second stage
on. Very long texts go through whole and end as several pieces. Other columns than those of
``documents`` are left out at the start. Empty tables, and an empty benchmark, give
empty results and no failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civiledger.llm import decontamination, minhash, packing, pii, quality_rules
from civiledger.llm.bpe import tokenizer_path
from civiledger.llm.common import documents, pick, scratch_path, table
from civiledger.llm.tagger import trained


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs, trained())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences."""
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", mask_pii),
    ("packing", pack),
]
#: Shingles, edit distances, the tagger and token ids are beyond SQL; a brute-force version in the tests stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(documents(spark, sf_dir), "doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
