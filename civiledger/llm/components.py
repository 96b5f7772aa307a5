"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b); root is the smallest node reachable.

    Each round maps every node to its smallest neighbour (or itself) and the
    links along with it, so at least half of the nodes of each component that
    is left are gone after two rounds. All rounds are joins and partial minima;
    nothing of the links reaches the driver but whether any is left.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = stored(edges.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while True:
        to = stored(both(left).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            step = to.select(F.col("a").alias("root"), "to")
            labels = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = stored(labels, "labels")
        a, b = to.select("a", F.col("to").alias("ra")), to.select(F.col("a").alias("b"), F.col("to").alias("rb"))
        left = left.join(a, "a").join(b, "b").filter("ra <> rb")
        left = stored(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if left.isEmpty():
            break
    return labels
