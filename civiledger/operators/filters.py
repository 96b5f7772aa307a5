"""Filters of the public lists, their sorts and pages, and what writing to a table means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import escape_like
from ..functions.text import digits, fold_lower, slug

# Folded names of payees that are no suppliers, by family.
EXCLUDED = {
    "payroll": "folha de pagamento|vencimentos|inss|previdencia",
    "utility": "energia|saneamento|telefonica|correios",
    "insurer": "seguradora|seguros",
    "transfer": "fundo municipal|consorcio|repasse",
    "tax": "receita federal|pasep|fgts",
}


def in_list(c: Column, values: list, empty_means_all: bool) -> Column:
    """Membership; an empty list stands for no filter, or for nothing."""
    return c.isin(*values) if values else F.lit(empty_means_all)


def contains_name(name: Column, key: Column, query: str) -> Column:
    """Names that hold the query as it stands, signs of patterns included, or whose key is its slug."""
    return fold_lower(name).like("%" + escape_like(query.lower()) + "%") | (key == F.concat(F.lit("pf-"), slug(F.lit(query))))


def exclusion_reason(tax_id: Column, name: Column) -> Column:
    """Why a payee is left out of comparisons: no company's tax id, or a family of names; null if it is not."""
    out = F.when(F.length(digits(F.coalesce(tax_id, F.lit("")))) != 14, "person")
    for family, pattern in EXCLUDED.items():
        out = out.when(fold_lower(name).rlike(pattern), family)
    return out


def either_year(instrument: Column, published: Column, year: int) -> Column:
    return F.coalesce(instrument == year, F.lit(False)) | F.coalesce(F.year(published) == year, F.lit(False))


def code_level(code: Column) -> Column:
    """Levels of a dotted code; trailing zero segments do not count."""
    return F.size(F.split(F.regexp_replace(code, r"(\.0+)+$", ""), r"\."))


def unpaid(settled: Column, paid: Column, kind: Column) -> Column:
    return settled.isNotNull() & paid.isNull() & ~F.coalesce(kind, F.lit("")).ilike("P%")


def oldest_first(rows: DataFrame, day: str, key: str, n: int, totals: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The oldest ``n`` rows, and totals of all."""
    return rows.orderBy(day, key).limit(n), rows.agg(*totals)


def flexible_date_key(c: Column) -> Column:
    """Days since 1970 of a date in either spelling; what cannot be read sorts as 0."""
    d = F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), c), "dd/MM/yyyy"), F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10)), "yyyy-MM-dd"))
    return F.coalesce(F.unix_date(d), F.lit(0))


def numeric_then_text(c: Column) -> list[Column]:
    """Sort keys: leading digits as a number (0 without any), then the text."""
    return [F.coalesce(F.nullif(F.regexp_extract(c, "^[0-9]+", 0), F.lit("")).cast("bigint"), F.lit(0)), c]


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page, with the number of all rows beside each of its rows."""
    total = rows.agg(F.count("*").alias("n_all"))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size).join(F.broadcast(total), F.lit(True))  # one row


def after_key(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def date_windows(first: Column, last: Column, days: int = 7) -> Column:
    """Closed windows of ``days`` days from first to last, the last one cut."""
    starts = F.sequence(first, last, F.expr(f"interval {days} day"))
    return F.transform(starts, lambda d: F.struct(d.alias("start"), F.least(F.date_add(d, days - 1), last).alias("end")))


def random_sample(rows: DataFrame, groups: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group by a hash of their key, the same ones for the same seed."""
    w = Window.partitionBy(*groups).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")


# writing


def inserted_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and the first of the new ones of each key that is not there."""
    first = new.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key]))).filter("_at = 1").drop("_at")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of all parents that come anew are exchanged as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def set_where_null(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """A value is written only where there is none; says whether it was. Of several new values of a key the least counts."""
    joined = old.join(new.groupBy(key).agg(F.min(column).alias("_new")), key, "left")
    return joined.withColumn("was_set", F.col(column).isNull() & F.col("_new").isNotNull()).withColumn(column, F.coalesce(column, "_new")).drop("_new")


def neutralised(rows: DataFrame, external: str, canonical: Column, columns: list[str]) -> DataFrame:
    """Of rows with one external id, those beside a canonical one lose these columns."""
    shared = rows.filter(F.coalesce(canonical, F.lit(False)) & F.col(external).isNotNull()).select(external).distinct().withColumn("_has", F.lit(True))
    joined = rows.join(shared, external, "left")  # a null id meets none
    hide = F.coalesce(F.col("_has") & ~canonical, F.lit(False))
    return joined.withColumn("_hide", hide).withColumns({c: F.when(~F.col("_hide"), F.col(c)) for c in columns}).select(*rows.columns)


def versioned_recompute(old: DataFrame, current: DataFrame, key: str, version: str, now: int) -> DataFrame:
    """Results of another version are exchanged for those computed anew, where there are any; the rest stays."""
    is_stale = ~F.col(version).eqNullSafe(F.lit(now))
    stale = old.filter(is_stale)
    new = current.join(stale.select(key), key, "left_semi").select(*old.columns)
    return old.filter(~is_stale).unionByName(stale.join(current.select(key), key, "left_anti").select(*old.columns)).unionByName(new)


def budgeted(rows: DataFrame, group: list[str], order: list, cost: Column, budget: float) -> DataFrame:
    """Rows of each group in order as long as their summed cost stays within the budget; the first always."""
    w = Window.partitionBy(*group).orderBy(*order)
    spent = rows.withColumn("_spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(w))
    return spent.filter((F.col("_spent") <= budget) | (F.col("_at") == 1)).drop("_spent", "_at")
