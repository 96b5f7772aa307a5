"""Merges: parts of an extraction into one, and duplicate records into their survivors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

# parts of an extraction
#
# The state of a merge has one row for each document and identity: the content's hash, the
# content, the least confidence, and whether contents contradicted one another. Merging two
# states takes, for each identity, the least hash and confidence and any contradiction, so the
# parts may come in any order and grouping, and a part that comes twice changes nothing.


def part_state(rows: DataFrame, document: str, identity: list[str], number: str, content: list[str], confidence: str) -> DataFrame:
    """The state of parts as they come. Rows without a number cannot contradict one another: they are told apart by content."""
    body = F.struct(*content)
    digest = F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)
    name = F.when(F.col(number).isNull(), F.concat(F.lit("content:"), digest)).otherwise(F.to_json(F.struct(*identity, number), {"ignoreNullFields": "false"}))
    each = rows.select(F.col(document).alias("document"), name.alias("identity"), digest.alias("digest"), body.alias("content"), F.col(confidence).cast("double").alias("confidence"), F.lit(False).alias("contradiction"))
    return merged_state(each)


def merged_state(*states: DataFrame) -> DataFrame:
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    clash = F.max("contradiction") | (F.min("digest") != F.max("digest"))
    return rows.groupBy("document", "identity").agg(F.min("digest").alias("digest"), F.min_by("content", "digest").alias("content"), F.min("confidence").alias("confidence"), clash.alias("contradiction"))


def covered(intervals: DataFrame, sources: DataFrame) -> DataFrame:
    """document, complete: whether the intervals (document, source, start, end) read all of each source (document, source, length) without a gap.

    Reaches are summed up by where an interval starts, so repeated ones count once.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("document", "source").orderBy("start")
    starts = intervals.filter("end > start").groupBy("document", "source", "start").agg(F.max("end").alias("end"))
    seen = starts.withColumn("before", F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    read = seen.groupBy("document", "source").agg(F.max("end").alias("upto"), F.max((F.col("start") > F.col("before")).cast("int")).alias("gap"))
    whole = sources.join(read, ["document", "source"], "left")
    good = (F.col("length") <= 0) | ((F.coalesce("gap", F.lit(1)) == 0) & (F.coalesce("upto", F.lit(0)) >= F.col("length")))
    return whole.groupBy("document").agg(F.min(good.cast("int")).cast("boolean").alias("complete"))


def merge_result(state: DataFrame, coverage: DataFrame) -> DataFrame:
    """document, n_rows, n_contradictions, confidence, verdict: merged, contradictory (a reader must look) or incomplete."""
    sums = state.groupBy("document").agg(F.count("*").alias("n_rows"), F.count_if("contradiction").alias("n_contradictions"), F.min("confidence").alias("confidence"))
    verdict = F.when(F.col("n_contradictions") > 0, "contradictory").when(~F.coalesce("complete", F.lit(False)), "incomplete").otherwise("merged")
    return sums.join(coverage, "document", "left").select("document", "n_rows", "n_contradictions", "confidence", verdict.alias("verdict"))


# duplicate records


@dataclass
class Child:
    """A table whose rows point to records by ``on``; ``once`` are the columns of which a record has each value once, ``key`` breaks ties."""

    rows: DataFrame
    on: str
    once: list[str]
    key: list[str]


def groups(pairs: DataFrame) -> DataFrame:
    """id, root for every id of the pairs (a, b): the least id that is linked with it, however long the chain."""
    links = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "pairs")
    roots = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("root", F.col("id"))
    left = links
    while not left.isEmpty():
        # each root joins the least root beside it, then links are between the new roots
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("root")).agg(F.least(F.min("b"), F.col("root")).alias("to")), "roots")
        roots = stored(roots.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "groups")
        a, b = to.toDF("a", "ta"), to.toDF("b", "tb")
        left = left.join(a, "a").join(b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a < b").distinct()
        left = stored(left, "pairs")
    return roots


def merge_duplicates(records: DataFrame, key: str, pairs: DataFrame, prefer: list[Column], children: dict[str, Child], provenance: list[str]) -> dict[str, DataFrame]:
    """The records that stay, ``merged`` (loser, survivor), each child table pointed to survivors, and ``provenance`` of the losers.

    Of each group of linked records the first by ``prefer`` (then the least key) survives;
    pairs of records that are not there are passed over. Of child rows that a
    survivor would have twice, its own stays, else the one with the least key, so nothing points to a loser and no value is lost.
    """
    there = pairs.join(records.select(F.col(key).alias("a")), "a", "left_semi").join(records.select(F.col(key).alias("b")), "b", "left_semi")
    member = groups(there).toDF("_id", "_root").join(records, F.col("_id") == F.col(key))
    order = F.struct(*prefer, F.col(key).alias("_key"))
    best = member.groupBy("_root").agg(F.min(order)["_key"].alias("survivor"))
    merged = stored(member.join(best, "_root").filter(F.col(key) != F.col("survivor")).select(F.col(key).alias("loser"), "survivor", *provenance), "merged")
    out = {"records": records.join(merged.select(F.col("loser").alias(key)), key, "left_anti"), "merged": merged.select("loser", "survivor"), "provenance": merged.select("survivor", *provenance).distinct()}
    ids = merged.select(F.col("loser").alias("_loser"), F.col("survivor").alias("_survivor"))
    for name, c in children.items():
        moved = c.rows.join(ids, F.col(c.on) == F.col("_loser"), "left").withColumn("_own", F.col("_survivor").isNull()).withColumn(c.on, F.coalesce("_survivor", c.on)).drop("_loser", "_survivor")
        first = F.min_by(F.struct(*c.rows.columns), F.struct(~F.col("_own"), *c.key))
        # only tables of records that took part can hold a value twice
        taken = moved.join(merged.select(F.col("survivor").alias(c.on)).distinct(), c.on, "left_semi")
        kept = taken.groupBy(c.on, *[F.col(x).alias(f"_{x}") for x in c.once]).agg(first.alias("_row")).select("_row.*")
        rest = moved.join(merged.select(F.col("survivor").alias(c.on)).distinct(), c.on, "left_anti").select(*c.rows.columns)
        out[name] = rest.unionByName(kept.select(*c.rows.columns))
    return out
