"""What the training-data operators share: scratch tables, inputs and small byte helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of ``documents``; operators read these and ignore any others.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset, in local
    mode only, a temporary folder is made once and kept on the session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_civiledger_scratch", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark._civiledger_scratch = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: executors lost later cost no earlier work, and
    what is read twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run meanwhile.

    A batch stands in memory several times, in the executor and in its Python
    worker, so rows that hold whole sets should not come by the usual 10,000.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written with :func:`stored`."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; those that are absent come as nulls of the usual type."""
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])
