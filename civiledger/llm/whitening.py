"""Whitening of embeddings by the Gramian of exactly centred rows.

Entries become integers, x = floor(64 c) + 1,000,000, so the sums S over all n
vectors are exact and a centred row is (n x - S) / n, an exact integer divided
once. MLlib's ``RowMatrix`` adds up the Gramian of the centred rows in its tree
of partial sums; divided by n it is the covariance. Only that matrix of the
dimensions comes to the driver, where ``eigh`` takes it apart; executors get the
mean and the scaled components and project whole Arrow batches. A second Gramian, of
the whitened rows, measures how far their covariance is from the identity.

Cases: rows are dropped whose vector is null, empty or holds null or non-finite
entries. All vectors have the table's dimension, the length that most of them have
(the greater of equals); others cannot be compared with them and are dropped, too.
Repeated rows count and come out as often as they occur; a null id is kept. A
component without variance (up to rounding) has a null ``whitened``, and
``explained`` is null where nothing varies at all; ``identity_error`` looks at the
components that vary, and is null without any. Ties of eigenvalues come in
``eigh``'s order. A ``deviation`` beyond 64 bits fails the query instead of being
wrong; the operator's own column is a decimal. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A component's variance counts as none below this share of the largest.
LEAST_SHARE = 1e-13


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and x of the rows that remain."""
    finite = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    x = rows.selectExpr("vec_id", "transform(get(filter(array(embedding), e -> " + finite.replace("embedding", "e") + f"), 0), c -> floor(CAST(c AS DOUBLE) * {SCALE}) + {SHIFT}L) AS x")
    x = stored(x.filter("x IS NOT NULL"), "vectors")
    usual = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (usual["d"] if usual else 0))


def _gramian(rows: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of all rows' vectors."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


class Whitener:
    """Sums, components by falling variance, and what executors need to project rows."""

    def __init__(self, x: DataFrame, most: int = COMPONENTS):
        """Fit on all rows of ``x``, of which there must be one."""
        d = x.first()["x"].__len__()
        first = x.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(d)]).first()
        self.n, self.sums = first[0], np.array(first[1:], np.int64)
        exact = F.expr(f"transform(x, (v, i) -> (v * {self.n}L - element_at(sums, i + 1)) / {float(self.n)!r}D)")
        centred = x.select("x", F.array(*[F.lit(int(s)) for s in self.sums]).alias("sums")).select(exact.alias("c"))
        self.covariance = _gramian(centred, "c") / self.n
        values, vectors = np.linalg.eigh((self.covariance + self.covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = np.maximum(values[order], 0.0), vectors[:, order]
        self.trace = float(np.trace(self.covariance))
        self.varies = self.values > LEAST_SHARE * max(float(values.max()), 0.0)

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]

    def transform(self, x: DataFrame) -> DataFrame:
        """vec_id, deviation and whitened, an array with null where a component has no variance."""
        n, sums, varies = self.n, self.sums, self.varies
        basis = self.vectors[:, varies] / np.sqrt(self.values[varies])
        kind = x.schema["vec_id"].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                off = np.stack(frame["x"].to_numpy()).astype(np.int64) * n - sums
                if off.size and float(np.abs(off).max()) ** 2 * off.shape[1] < 2**62:
                    square = (off * off).sum(1).tolist()
                else:
                    square = [sum(v * v for v in row) for row in off.tolist()]
                out = np.full((len(off), len(varies)), None, object)
                out[:, varies] = off / n @ basis
                yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy(), "deviation": [Decimal(v) for v in square], "whitened": list(out)})

        return x.mapInPandas(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, rows: DataFrame) -> float | None:
        """Largest absolute entry of the whitened rows' covariance minus the identity."""
        (at,) = np.nonzero(self.varies)
        if not len(at):
            return None
        mean = rows.agg(*[F.avg(F.get("whitened", F.lit(int(k)))).alias(f"m{k}") for k in at]).first()
        centred = rows.select(F.array(*[F.get("whitened", F.lit(int(k))) - F.lit(m) for k, m in zip(at, mean, strict=True)]).alias("c"))
        return float(np.abs(_gramian(centred, "c") / self.n - np.eye(len(at))).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, Whitener | None]:
    """vec_id, deviation and the array ``whitened`` of each remaining row, and the fitted whitener; None without rows."""
    x = whole_vectors(embeddings.select("vec_id", "embedding"))
    fitted = None if x.isEmpty() else Whitener(x, most)
    if fitted is None:
        kind = x.schema["vec_id"].dataType
        return x.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).to(_empty(kind)), None
    return stored(fitted.transform(x), "whitened"), fitted


def _empty(kind):
    from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

    return StructType([StructField("vec_id", kind), StructField("deviation", DecimalType(38, 0)), StructField("whitened", ArrayType(DoubleType()))])


def components(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, fitted = whiten(embeddings, most)
    shares = fitted.explained() if fitted else []
    error = fitted.identity_error(rows) if fitted else None
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return long.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(fitted.n if fitted else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in shares] or [F.lit(None).cast("double")]), F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = components(table(spark, sf_dir, "embeddings"))
    return got.withColumn("deviation", F.col("deviation").cast("bigint"))
