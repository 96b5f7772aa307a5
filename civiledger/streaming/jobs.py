"""Incremental ingestion: upserts, watermarks and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """Both tables by natural key; the newest row of a key wins."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return old.unionByName(new).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def increment(rows: DataFrame, changed: str, since: str) -> DataFrame:
    return rows.filter(F.col(changed) > F.lit(since).cast("timestamp"))


def contiguous_progress(windows: DataFrame, order: str, done: str) -> DataFrame:
    """The last window before which all are done (null where the first is not). ``windows`` is the plan of a job: few rows."""
    first_open = windows.filter(~F.col(done)).agg(F.min(order).alias("stop"))
    rows = windows.join(F.broadcast(first_open))
    return rows.filter(F.col("stop").isNull() | (F.col(order) < F.col("stop"))).agg(F.max(order).alias("done_until"), F.count("*").alias("n_done"))


def stream_of(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, at: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window, tumbling or sliding; later events than the watermark are dropped by a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width, slide) if slide else F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def run_upserts(stream: DataFrame, target: str, keys: list[str], newest: Callable[[], list[Column]], checkpoint: str) -> None:
    """Drain a stream into versions of a table: each batch is merged once, and running it again changes nothing.

    Version ``n`` is written whole under its batch number, so a batch that is
    repeated after a failure overwrites its own version only.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = upserted(spark.read.parquet(f"{target}/v={number - 1}"), batch, keys, *newest()) if number else upserted(batch.limit(0), batch, keys, *newest())
        new.write.mode("overwrite").parquet(f"{target}/v={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
