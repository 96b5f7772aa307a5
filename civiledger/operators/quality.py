"""Data-quality reports, reconciliation and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: str, what: Column) -> DataFrame:
    """Groups of more than one row with the same content: size and first key."""
    out = rows.groupBy(F.sha2(what, 256).alias("content")).agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    return out.filter("n > 1")


def reconciled(items: DataFrame, totals: DataFrame, key: str, item_value: str, total_value: str, absolute: float, relative: float) -> DataFrame:
    """Sum of items against the stated total: validated, divergent or without items."""
    sums = items.groupBy(key).agg(F.sum(item_value).alias("item_sum"))
    gap = F.abs(F.col("item_sum") - F.col(total_value))
    status = F.when(F.col("item_sum").isNull(), "no match").when((gap <= absolute) | (gap <= relative * F.col(total_value)), "validated").otherwise("divergent")
    return totals.join(sums, key, "left").select(key, F.col(total_value).cast("double").alias("stated"), F.col("item_sum").cast("double").alias("item_sum"), status.alias("status"))


def gaps(rows: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row a group and field: how many rows lack it, of how many, in percent."""
    flags = rows.select(*keys, *[F.when(c.isNull(), 1).otherwise(0).alias(n) for n, c in fields.items()])
    long = flags.unpivot(keys, list(fields), "field", "missing")
    out = long.groupBy(*keys, "field").agg(F.sum("missing").alias("n_missing"), F.count("*").alias("n_rows"))
    return out.withColumn("percent", F.floor(100 * F.col("n_missing") / F.col("n_rows") + 0.5).cast("bigint"))


def bands(rows: DataFrame, score: Column) -> DataFrame:
    band = F.when(score <= 25, "0-25").when(score <= 50, "26-50").when(score <= 75, "51-75").otherwise("76-100")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """inserted, updated, unchanged or deleted for every key, by a hash of the other columns."""
    fields = [c for c in new.columns if c != key]
    hashed = lambda d, n: d.select(key, F.xxhash64(*fields).alias(n))
    both = hashed(old, "was").join(hashed(new, "now"), key, "full_outer")
    return both.select(key, F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated").alias("change"))


def table_hash(rows: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Rows and a hash that does not depend on their order."""
    columns = [c for c in rows.columns if c not in volatile]
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("hash"))


def mirror_deletions(index: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Ids of the index that the source no longer has; none where the source was read empty."""
    any_ = source.limit(1).select(F.lit(True).alias("_any"))
    gone = index.select(key).join(source.select(key), key, "left_anti")
    return gone.join(F.broadcast(any_)).select(key)  # one row at most
