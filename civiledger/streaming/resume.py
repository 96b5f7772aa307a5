"""Loads that go on where a killed run has stopped, and upserts by stream, into bucketed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import BucketedTable
from .jobs import upserted

ACTIONS = ("inserted", "updated", "unchanged")


class Diverged(ValueError):
    """The kept input is not what the progress counts."""


def _actions(old: DataFrame, new: DataFrame, keys: list[str]) -> dict[str, int]:
    """How many of the new rows insert, update or leave a row as it is."""
    fields = [c for c in new.columns if c not in keys]
    hashed = lambda d, n: d.select(*keys, F.xxhash64(*fields).alias(n))
    both = hashed(new, "now").join(hashed(old, "was").withColumn("there", F.lit(True)), keys, "left")
    what = F.when(F.col("there").isNull(), "inserted").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    counts = dict(both.groupBy(what.alias("what")).count().collect())
    return {a: counts.get(a, 0) for a in ACTIONS}


def resumed_load(target: BucketedTable, job: str, read: Callable[[], DataFrame], prepare: Callable[[DataFrame], DataFrame], slices: int = 8, going_on: Callable[[int], None] = lambda k: None) -> dict:
    """Upsert all that ``read`` gives into the target, slice by slice; returns counts of rows inserted, updated and unchanged.

    The input is kept when it is first read, so a resumed run works on the same
    rows, and the cursor is committed with the slice it counts: a slice is written
    once, whatever kills the run between two. Slices are groups of buckets, so each
    touches its own. Of rows with one key in the input, the last by all columns counts.
    ``going_on`` is asked before each slice and may raise, such as at the end of a time budget.
    A job that is done does nothing more.
    """
    spark, files, keys = target.spark, target.files, target.keys
    state = target.note().get(job)
    if state is None:
        folder = files.folder()
        read().write.parquet(f"{files.root}/{folder}")
        rows = spark.read.parquet(f"{files.root}/{folder}")
        state = {"input": folder, "rows": rows.count(), "next": 0, **dict.fromkeys(ACTIONS, 0)}
        target.merge(spark.createDataFrame([], target.schema), upserted, {job: state})
    rows = spark.read.parquet(f"{files.root}/{state['input']}")
    if rows.count() != state["rows"] or not 0 <= state["next"] <= slices:
        raise Diverged(f"the kept input of {job} is not what its progress counts")
    for k in range(state["next"], slices):
        going_on(k)
        part = prepare(rows).filter(F.pmod(target.bucket(), F.lit(slices)) == k)
        order = [F.desc(c) for c in part.columns if c not in keys] or [F.lit(1)]
        part = part.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at").persist()
        try:
            state = dict(state, next=k + 1)

            def merged(old: DataFrame, new: DataFrame) -> DataFrame:
                for a, n in _actions(old, new, keys).items():
                    state[a] += n
                    note[job][a] = state[a]
                return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)

            note = {job: dict(state)}
            target.merge(part, merged, note)
        finally:
            part.unpersist()
    return {a: state[a] for a in ACTIONS}


def run_bucketed_upserts(stream: DataFrame, target: BucketedTable, newest: Callable[[], list[Column]], checkpoint: str) -> None:
    """Drain a stream into a bucketed table: each batch rewrites the buckets of its keys, and old versions go.

    The manifest notes the batch, so one that is repeated after a failure is not merged again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if target.note().get("batch", -1) >= number:
            return
        rows = batch.select(*target.read([]).columns).persist()
        try:
            target.merge(rows, lambda old, new: upserted(old, new, target.keys, *newest()), {"batch": number})
        finally:
            rows.unpersist()
        target.files.vacuum(keep=2)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
