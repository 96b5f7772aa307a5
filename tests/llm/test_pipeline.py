"""The pipeline's stages in order, each against its own brute force or rule."""

from __future__ import annotations

import corpus_pipeline
from civiledger.llm import decontamination, packing, pii
from comparing import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, near, clean, masked = kept
    assert set(near) <= set(quality) and set(clean) <= set(near) and set(masked) == set(clean)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in quality.items() for w in [t.encode().lower().split()]}
    ids = sorted(near)
    for a in ids:
        for b in ids:
            assert b >= a or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in t for t in clean.values() for item in items)
    held = decontamination.leaks(spark.createDataFrame(list(near.items()), "doc_id bigint, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r["doc_id"] for r in held.collect()} == set(near) - set(clean)
    assert not any(pii.base_spans(t) for t in masked.values())
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(masked) and all(r["offset"] + r["length"] <= packing.CAPACITY for r in rows)


def test_the_registered_query_runs(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"](spark, SF).count() > 0
