"""Windows, sequences and order-dependent scans."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import scan_sorted


def latest_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def top_n(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def merged_islands(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching spans of a key become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count("*").alias("n_spans"))


def greedy_forward_windows(entries: DataFrame, key: str, date: str, value: str, days: int, least_dates: int, limit: float) -> DataFrame:
    """Windows of ``days`` from an entry on with enough distinct dates and value; a hit skips past its end.

    Which windows are found depends on those found before, so each key is
    scanned in date order. Entries are summed by key and day first, which bounds
    a scan by the days of one key.
    """
    daily = entries.groupBy(key, date).agg(F.sum(value).cast("double").alias("v"), F.count("*").alias("n"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        d, v, n = pd.to_datetime(pdf[date]).to_numpy(), pdf["v"].to_numpy(), pdf["n"].to_numpy()
        ends = d.searchsorted(d + pd.Timedelta(days=days), side="right")
        out, i = [], 0
        while i < len(d):
            j = ends[i]
            total = round(float(v[i:j].sum()), 2)
            if j - i >= least_dates and total >= limit:
                out.append((pdf[key].iloc[0], str(d[i])[:10], str(d[j - 1])[:10], int(j - i), int(n[i:j].sum()), total))
                i = j
            else:
                i += 1
        return pd.DataFrame(out, columns=[key, "window_start", "window_end", "n_dates", "n_entries", "total"])

    kind = dict(entries.dtypes)[key]
    return daily.groupBy(key).applyInPandas(scan, f"{key} {kind}, window_start string, window_end string, n_dates bigint, n_entries bigint, total double")


def best_month_window(daily: DataFrame, key: str, date: str, value: str, months: int) -> DataFrame:
    """The start whose following calendar months hold most, by key; the end day counts. ``daily`` has a row a key and day.

    A window's total is the running sum at its end less what is before its start: ends are put among the days, so no pairs of days are made.
    """
    order = Window.partitionBy(key)
    before = F.coalesce(F.sum(value).over(order.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = daily.select(key, F.col(date).alias("start"), F.add_months(date, months).alias("end"), F.col(value).alias("_v"), before.alias("_before"))
    points = days.select(key, F.col("start").alias("_at"), F.lit(0).alias("_is_end"), "_v", "start", "end", "_before").unionByName(
        days.select(key, F.col("end").alias("_at"), F.lit(1).alias("_is_end"), (F.col("_v") * 0).cast(days.schema["_v"].dataType).alias("_v"), "start", "end", "_before")
    )
    upto = F.sum("_v").over(order.orderBy("_at", "_is_end").rowsBetween(Window.unboundedPreceding, 0))
    sums = points.withColumn("_upto", upto).filter("_is_end = 1").select(key, "start", "end", (F.col("_upto") - F.col("_before")).alias("total"))
    return latest_row(sums, [key], F.desc("total"), F.col("start"))


def missing_numbers(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Gaps between present numbers of a group, with their neighbours."""
    w = Window.partitionBy(*keys).orderBy(number)
    gaps = rows.select(*keys, number).distinct().withColumn("after", F.lead(number).over(w)).filter(F.col("after") > F.col(number) + 1)
    return gaps.select(*keys, F.col(number).alias("before"), "after", F.explode(F.sequence(F.col(number) + 1, F.col("after") - 1)).alias("missing"))


def leave_one_out_peaks(totals: DataFrame, keys: list[str], value: str, factor: float, least_others: int) -> DataFrame:
    """Rows at least ``factor`` times the mean of the group's other rows."""
    w = Window.partitionBy(*keys)
    rows = totals.withColumns({"_n": F.count("*").over(w), "_s": F.sum(value).over(w)})
    rows = rows.withColumn("others_mean", (F.col("_s") - F.col(value)) / (F.col("_n") - 1)).filter(F.col("_n") > least_others)
    return rows.filter(F.col(value) >= factor * F.col("others_mean")).drop("_n", "_s")


def group_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation, rounded to cents before further use."""
    v = F.col(value).cast("double")
    from ..functions.money import half_up

    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), half_up(F.avg(v), 2).alias("mean"), half_up(F.stddev_pop(v), 2).alias("deviation"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def outliers(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Rows whose distance from the group's mean is ``least`` deviations or more."""
    stats = group_stats(rows, keys, value)
    joined = rows.join(stats, keys).filter("deviation > 0")
    return joined.withColumn("z", F.floor((F.col(value) - F.col("mean")) / F.col("deviation") * 100 + 0.5) / 100).filter(F.col("z") >= least)


def anchored_buckets(events: DataFrame, key: str, at: str, text: str, seconds: int) -> DataFrame:
    """Texts joined in buckets of at least ``seconds``, each anchored at its first event."""

    def scan() -> Callable[[tuple | None], list[tuple]]:
        # what is held for a key is its open bucket
        bucket: list = []

        def step(row: tuple | None) -> list[tuple]:
            closed = []
            if bucket and (row is None or (row[1] - bucket[1]).total_seconds() >= seconds):
                closed = [(bucket[0], bucket[1], len(bucket[2]), " ".join(bucket[2]).strip())]
                bucket.clear()
            if row is not None:
                if not bucket:
                    bucket.extend([row[0], row[1], []])
                bucket[2].append(row[2] or "")
            return closed

        return step

    kind = dict(events.dtypes)[key]
    return scan_sorted(events.select(key, at, text), [key], [at, text], f"{key} {kind}, bucket_start timestamp, n bigint, joined string", scan)
