"""The pipeline over awkward and empty tables."""

from __future__ import annotations

import collections

import corpus_pipeline
from awkward_rows import SCHEMA, awkward_rows, prose
from civiledger.llm.common import DOC_COLUMNS

ITEMS = [(1, None), (2, ""), (3, "one"), (4, prose(3, 80)), (4, prose(3, 80)), (None, "a b c")]


def tables(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS if rows else [], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; each stage gets all columns that there are."""
    good = [(100 + k, f"{prose(50 + k, 70)}.\n{prose(90 + k, 40)}.", "en", "src", 1, *["x"] * (len(awkward_rows()[0]) - 5)) for k in range(30)]
    rows = awkward_rows() + good + good[:3]
    folder = tables(spark, tmp_path / "in", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert tuple(docs.columns) == DOC_COLUMNS
            after = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
            if k < 3:
                assert after <= before and after, name
            before = after
    kept = {r["doc_id"] for r in docs.collect()}
    assert {100 + k for k in range(30)} <= kept  # clean documents stay, copies of them or not
    assert not {1, 2, 3, 10, 11} & kept  # without twenty words
    assert sum(1 for r in docs.collect() if r["doc_id"] == 100 and r["piece"] == 0) == 1


def test_an_empty_table_and_an_empty_benchmark(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
