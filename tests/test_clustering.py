"""Greedy clusters against a scan row by row, at any block size."""

import os
import random

import numpy as np
import pytest
from civiledger.operators import clustering, vector_store
from civiledger.plans import catalogue
from civiledger.sources.scratch import scratch_root
from comparing import SF
from pyspark.sql import functions as F


def scan(rows, least):
    """key: centre, row by row."""
    centres, out = {}, {}
    for g, k, v, w in sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else float("-inf")), r[1])):
        x = np.array(v, float)
        x = x / max(np.linalg.norm(x), 1e-12)
        of = centres.setdefault(g, [])
        near = [round(float(c @ x), 12) for _, c in of]
        if near and max(near) >= least:
            out[k] = of[int(np.argmax(near))][0]
        else:
            of.append((k, x))
            out[k] = k
    return out


@pytest.mark.parametrize("block", [1, 3, 50, 512])
def test_blocks_equal_the_plain_scan(spark, block):
    r = random.Random(block)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    # one group holds most rows; some have no weight, one no length, several are copies
    rows = [(r.choice(["a", "a", "a", "b", None]), k, [m + r.gauss(0, 0.4) for m in r.choice(middles)], r.choice([None, 1.0, 1.0, 2.0, 5.0])) for k in range(40 if block < 3 else 160)]
    rows += [("a", 900 + i, rows[0][2], 1.0) for i in range(5)] + [("b", 999, [0.0] * 6, 1.0)]
    frame = spark.createDataFrame(rows, "g string, k bigint, v array<double>, w double").repartition(3)
    got = {x["k"]: x["centre"] for x in clustering.greedy_clusters(frame, "g", "k", "v", "w", 0.8, block).collect()}
    assert got == scan(rows, 0.8)


def test_product_clusters_against_a_plain_scan(spark):
    got = {r["description"]: (r["centre"], r["weight"]) for r in catalogue.QUERIES["product_clusters"](spark, SF).collect()}
    parts = spark.read.parquet(f"{SF}/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("description"))
    weight = {r["description"]: r["count"] for r in parts.groupBy("description").count().collect()}
    vectors = {r["description"]: r["vector"] for r in vector_store.hashed_embedding(parts.distinct(), "description", "description", 64).collect()}
    want = scan([(0, d, vectors[d], float(n)) for d, n in weight.items()], 0.6)
    assert {d: c for d, (c, _) in got.items()} == want and {d: n for d, (_, n) in got.items()} == weight and len(set(want.values())) < len(want)


def test_settled_rows_are_written_once(spark):
    """Vectors that are all centres take many rounds; none writes the others again."""
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    r = random.Random(1)
    rows = [("a", k, [r.gauss(0, 1) for _ in range(40)], 1.0) for k in range(60)]
    got = clustering.greedy_clusters(spark.createDataFrame(rows, "g string, k bigint, v array<double>, w double"), "g", "k", "v", "w", 0.9, 6).collect()
    assert all(x["centre"] == x["k"] and x["similarity"] == 1.0 for x in got) and len(got) == 60
    written = sum(spark.read.parquet(f"file://{root}/{d}").count() for d in set(os.listdir(root)) - before)
    assert written <= 2 * len(rows)
