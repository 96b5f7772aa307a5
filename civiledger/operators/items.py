"""The items of a process as a view: rows of four roles, the richest of repeated ones, and what is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_lower

ITEM, LOT, WHOLE, DROPPED = "item", "lot result", "whole result", "dropped"
# What leaks from a page's foot or head into a description; all behind it goes.
LEAKS = (
    r"(?is)\s*[-–]?\s*e-?mail\s*:.*", r"(?is)\s*à\s*vista\s*da\s*habilita.*", r"(?is)\s*valor\s*global\s*da\s*proposta.*", r"(?is)\s*fornecedor\s+valor.*",
    r"(?is)\s*classifica[çc][aã]o\s+posi[çc][aã]o.*", r"(?s)\s*[0-9]+\s+&.*",
)
COLUMNS = "process bigint, id bigint, item string, lot string, description string, quantity double, unit string, unit_estimate double, total_estimate double, unit_final double, total_final double, lot_final double, whole_final double, final_kind string, supplier string, origin string"


def cleaned(description: Column) -> Column:
    out = F.trim(F.coalesce(description, F.lit("")))
    for p in LEAKS:
        out = F.trim(F.regexp_replace(out, p, ""))
    return out


def role(clean: Column) -> Column:
    """What a row is: the kind said of its value counts before the value that is there; a row without any letter is none."""
    has = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    kind = F.coalesce("final_kind", F.lit(""))
    return (
        F.when(~clean.rlike("[A-Za-zÀ-ÿ]"), DROPPED).when((kind == "global") | has("whole_final"), WHOLE).when((kind == "lote") | has("lot_final"), LOT).otherwise(ITEM)
    )


def richness() -> Column:
    """Supplier 4, a final value 3, from the minutes 2, a quantity 1."""
    has = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    points = ((F.coalesce(F.col("supplier") != "", F.lit(False)), 4), (has("lot_final") | has("total_final") | has("unit_final") | has("whole_final"), 3), (F.coalesce(F.contains("origin", F.lit("ata_resultado")), F.lit(False)), 2), (has("quantity"), 1))
    out = F.lit(0)
    for c, n in points:
        out = out + F.when(c, n).otherwise(0)
    return out


def item_view(rows: DataFrame) -> DataFrame:
    """The rows that stand for each thing of a process, with role, clean, estimate, result and the reason for what is dropped.

    Repeated rows are those of one role with the same item and description, the same
    lot (or, without one, description), or, for whole results, description; the richest
    stands, and of equals the least id. Of several whole results only that with the least id stays. Dropped rows all stay.
    """
    named = rows.select("*", F.explode(F.array(cleaned(F.col("description")))).alias("clean"))
    named = named.withColumns({"role": role(F.col("clean")), "rich": richness()})
    words = fold_lower(F.col("clean"))
    same = (
        F.when(F.col("role") == ITEM, F.concat(F.coalesce("item", F.lit("")), F.lit("|"), words)).when(F.col("role") == LOT, F.when(F.coalesce("lot", F.lit("")) != "", F.concat(F.lit("L"), "lot")).otherwise(F.concat(F.lit("D"), words)))
        .when(F.col("role") == WHOLE, words).otherwise(F.col("id").cast("string"))
    )
    row = F.struct(*[c for c in named.columns if c not in ("process", "role")])
    best = named.withColumn("same", same).groupBy("process", "role", "same").agg(F.min_by(row, F.struct(-F.col("rich"), F.col("id"))).alias("r"), F.min("id").alias("first_id"))
    # whole results: the one that came first
    whole = best.groupBy("process").agg(F.min(F.when(F.col("role") == WHOLE, F.col("first_id"))).alias("whole_id"))
    kept = best.join(whole, "process").filter((F.col("role") != WHOLE) | (F.col("first_id") == F.col("whole_id"))).select("process", "role", "r.*")
    own = ~F.coalesce("final_kind", F.lit("")).isin("lote", "global")
    result = F.when((F.col("role") == ITEM) & own, F.coalesce("total_final", "unit_final")).when(F.col("role") == LOT, F.col("lot_final")).when(F.col("role") == WHOLE, F.col("whole_final"))
    estimate = F.coalesce("total_estimate", F.col("unit_estimate") * F.col("quantity"), "unit_estimate")
    reason = F.when(F.col("role") == DROPPED, F.when((F.trim("description") != "") & (F.trim("description") != F.col("clean")), "leak").otherwise("no content"))
    return kept.withColumns({"estimate": F.when(F.col("role") == ITEM, estimate), "result": result, "reason": reason})


def view_coverage(view: DataFrame) -> DataFrame:
    """process, n_items, n_lots, n_dropped, has_result, only_demand."""
    n = lambda r: F.count_if(F.col("role") == r)
    out = view.groupBy("process").agg(
        n(ITEM).alias("n_items"), n(LOT).alias("n_lots"), n(DROPPED).alias("n_dropped"), (F.max(F.when(F.col("role").isin(LOT, WHOLE) | ((F.col("role") == ITEM) & F.col("result").isNotNull()), 1).otherwise(0)) == 1).alias("has_result"))
    return out.withColumn("only_demand", (F.col("n_items") > 0) & ~F.col("has_result"))
