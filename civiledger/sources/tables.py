"""Tables of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as ledger entries: entry_id, payee_id, kind, value (decimal), entry_date, fiscal_year, unit."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_custkey").alias("payee_id"), F.col("o_orderstatus").alias("kind"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value"), F.to_date("o_orderdate").alias("entry_date"),
        F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderpriority").alias("unit"),
    )
