"""Scans that depend on order, in bounded memory.

Rows are dealt by key and sorted within their task; a task reads them in batches
and holds only the state of the key that it is at, never a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def scan_sorted(rows: DataFrame, keys: list[str], order: list, schema: str, scan: Callable[[], Callable[[tuple | None], list[tuple]]]) -> DataFrame:
    """``scan()`` gives a function for one key: called with each row in order, then with None at the end, it gives the rows to put out."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    width = len(keys)
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if step is None or row[:width] != last:
                    if step is not None:
                        out += step(None)
                    last, step = row[:width], scan()
                out += step(row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)
        if step is not None and (rest := step(None)):
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rest], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(run, schema)
