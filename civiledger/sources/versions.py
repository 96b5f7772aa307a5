"""Stored tables whose state is a numbered manifest: readers see one whole version, writers switch to the next at once.

Data folders never change. A manifest, a small JSON file, names those that make
up a version; the greatest number is the table's state. It is written beside its place
and renamed there, and a number that is taken refuses, so of two writers one has
to begin anew. A run that dies before its manifest leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed this number."""


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.listed("versions") if n.endswith(".json"))

    def at(self, number: int) -> dict:
        (row,) = self.spark.read.text(f"{self.root}/versions/{number}.json", wholetext=True).collect()
        return json.loads(row[0])

    def current(self) -> tuple[int, dict | None]:
        """The last number and its manifest; 0 and None where there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.at(numbers[-1])) if numbers else (0, None)

    def folder(self) -> str:
        """A name for new data."""
        return f"data/{uuid.uuid4().hex}"

    def commit(self, number: int, manifest: dict) -> None:
        beside, place = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{number}.json")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(beside, place):
            self._fs.delete(beside, False)
            raise Conflict(f"version {number} of {self.root} is there")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the last ``keep`` versions, and all data that none of those names; no writer may be at work. Returns the data dropped."""
        numbers = self.numbers()
        kept = {f for n in numbers[-keep:] for f in named(self.at(n))}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n}.json"), False)
        gone = []
        for f in (f"data/{x}" for x in self.listed("data")):
            if f not in kept and not any(k.startswith(f + "/") for k in kept):
                gone.append(f)
            elif f not in kept:  # some of its buckets are still named
                gone += [g for g in (f"{f}/{x}" for x in self.listed(f) if "=" in x) if g not in kept]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)
        return gone


def named(manifest: dict) -> set[str]:
    """All data folders that a manifest names, at any depth."""
    if isinstance(manifest, str):
        return {manifest} if manifest.startswith("data/") else set()
    parts = manifest.values() if isinstance(manifest, dict) else manifest if isinstance(manifest, list) else ()
    return set().union(*map(named, parts))


class BucketedTable:
    """Rows dealt by a hash of their key; a write replaces only the buckets that it touches.

    A manifest holds each bucket's folder and what a writer notes beside it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.files = Manifests(spark, root)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.files.root}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, only: Iterable[int] | None = None, number: int | None = None) -> DataFrame:
        """The table as the last version (or ``number``) has it, or some buckets of it."""
        manifest = self.files.at(number) if number else self.files.current()[1] or {"buckets": {}}
        wanted = None if only is None else {str(b) for b in only}
        return self._rows(f for b, f in sorted(manifest["buckets"].items()) if wanted is None or b in wanted)

    def note(self) -> dict:
        return (self.files.current()[1] or {}).get("note", {})

    def _written(self, rows: DataFrame) -> dict[str, str]:
        folder = self.files.folder()
        # AQE splits a bucket that is too large for one task and joins small ones
        dealt = rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.files.root}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self.files.listed(folder) if n.startswith("_bucket=")}

    def replace(self, rows: DataFrame, note: dict | None = None) -> int:
        """Rebuild the whole table; readers have the old one until the switch."""
        number = self.files.current()[0] + 1
        self.files.commit(number, {"buckets": self._written(rows), "note": note or {}})
        return number

    def merge(self, batch: DataFrame, merged, note: dict | None = None) -> list[int]:
        """Put ``merged(old, batch)`` in the place of the buckets that the batch's keys fall into; returns those.

        ``batch`` is read twice, so it should be stored or cached.
        """
        number, manifest = self.files.current()
        before = manifest or {"buckets": {}, "note": {}}
        touched = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # as many as there are buckets at most
        old = self._rows(before["buckets"][str(b)] for b in sorted(touched) if str(b) in before["buckets"])
        new = self._written(merged(old, batch)) if touched else {}
        stay = {b: f for b, f in before["buckets"].items() if int(b) not in set(touched)}
        self.files.commit(number + 1, {"buckets": stay | new, "note": before["note"] | (note or {})})
        return sorted(touched)
