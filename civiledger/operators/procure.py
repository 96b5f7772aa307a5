"""Procurement, payroll and earmarks: statistics, inference of winners, consolidation of results, and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_statistics(rows: DataFrame, year: str, modality: str, flags: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """One row a year: rows, counts of flags, sums, and rows of each modality as a sorted list."""
    keyed = rows.groupBy(year, modality).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.sum(c).alias(n) for n, c in sums.items()])
    out = keyed.groupBy(year).agg(
        F.sum("n").alias("n_rows"), *[F.sum(n).alias(n) for n in flags], *[F.sum(n).cast("double").alias(n) for n in sums],
        F.array_join(F.array_sort(F.collect_list(F.concat(F.col(modality), F.lit("="), F.col("n").cast("string")))), ",").alias("by_modality"),
    )
    return out


def winners(rows: DataFrame, document: str, payee: str, value: str) -> DataFrame:
    """The payee of each document with most value, then most rows, then the least name."""
    sums = rows.groupBy(document, payee).agg(F.sum(value).alias("won"), F.count("*").alias("n"))
    w = Window.partitionBy(document).orderBy(F.desc("won"), F.desc("n"), payee)
    return sums.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def consolidated_results(items: DataFrame, key: str) -> DataFrame:
    """Results of an external procurement by process: items (item_no, closed, cancelled, results of supplier, total and date).

    Cancelled results do not count. A winner is named only where all closed items
    have one and the same supplier; a sum stands only where every item is closed
    and has its totals; the date is the latest.
    """
    kept = items.withColumn("good", F.filter("results", lambda r: ~F.coalesce(r["cancelled"], F.lit(False))))
    each = kept.select(
        key, "closed", F.size("good").alias("n"), F.when(F.col("closed"), F.transform("good", lambda r: r["supplier"])).alias("suppliers"),
        F.aggregate("good", F.lit(0).cast("decimal(18,2)"), lambda s, r: (s + F.coalesce(r["total"], F.lit(0)).cast("decimal(18,2)")).cast("decimal(18,2)")).alias("total"),
        F.exists("good", lambda r: r["total"].isNull()).alias("lacks"), F.array_max(F.transform("good", lambda r: r["day"])).alias("day"),
    )
    flat = F.array_distinct(F.flatten(F.collect_list("suppliers")))
    out = each.groupBy(key).agg(
        F.count("*").alias("n_items"), F.count_if("closed").alias("n_closed"), flat.alias("s"), F.sum("total").alias("t"),
        F.bool_and(F.col("closed") & (F.col("n") > 0) & ~F.col("lacks")).alias("complete"), F.max("day").cast("string").alias("result_day"),
    )
    return out.select(key, "n_items", "n_closed", F.when(F.size("s") == 1, F.col("s")[0]).alias("winner"), F.when(F.col("complete"), F.col("t").cast("double")).alias("total"), "result_day")


def unified_earmarks(parts: DataFrame, keys: list[str], value: str, detail: str, part: str) -> DataFrame:
    """Parts of one earmark put together: their sum, the longest detail (ties by text), and the parts in order."""
    return parts.groupBy(*keys).agg(
        F.sum(value).cast("double").alias("total"), F.max(F.struct(F.length(detail), F.col(detail)))[detail].alias("detail"), F.array_join(F.array_sort(F.collect_list(part)), ",").alias("parts")
    )


def latest_regular_month(payroll: DataFrame) -> DataFrame:
    """year and month of the latest month that is none of the extra ones."""
    return payroll.filter(F.col("month").between(1, 12)).agg(F.max(F.struct("year", "month")).alias("m")).select("m.year", "m.month")


def payroll_by_department(payroll: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Distinct registrations and gross pay by department in the latest regular month. Aliases are a parameter of a few entries."""
    name = F.coalesce(*[F.when(F.col("department") == a, F.lit(b)) for a, b in sorted(aliases.items())], F.col("department"))
    now = latest_regular_month(payroll)
    rows = payroll.join(F.broadcast(now), ["year", "month"])  # one row
    return rows.groupBy(name.alias("department")).agg(F.countDistinct("bond", "registration").alias("n_people"), F.sum("gross").cast("double").alias("gross"))


def cascade(rows: DataFrame, others: DataFrame, exact: list[str], window: Column, order: list, key: str, other_key: str) -> DataFrame:
    """The match by exact key, else the best one that the window allows: key, other_key, how."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.join(others, exact).groupBy(key).agg(F.min(other_key).alias(other_key)).withColumn("how", F.lit("exact"))
    rest = rows.join(first.select(key), key, "left_anti")
    near = rest.join(others.toDF(*[f"o_{c}" if c in rows.columns else c for c in others.columns]), window)
    near = near.withColumn("_at", F.row_number().over(w)).filter("_at = 1").select(key, other_key, F.lit("window").alias("how"))
    return first.unionByName(near)


def preferred(rows: DataFrame, others: DataFrame, on: str, year: str, other_year: str, newest: Column, pick: str) -> DataFrame:
    """For each row the other with its number: the newest of the same year, else the newest of all.

    The others are summed up by number and year, and then by number, before they are joined, so no pairs are made.
    """
    best = F.max_by(F.col(pick), newest).alias(pick)
    by_year = others.groupBy(on, F.col(other_year).alias(year)).agg(best, F.max(newest).alias("_newest"))
    overall = by_year.groupBy(on).agg(F.max_by(F.col(pick), F.col("_newest")).alias("_any"))
    joined = rows.join(by_year.drop("_newest"), [on, year], "left").join(overall, on)
    return joined.withColumn(pick, F.coalesce(pick, "_any")).drop("_any")


def fullest(rows: DataFrame, keys: list[str], fields: list[str], tie: str) -> DataFrame:
    """Of the rows with the same keys, the one with most fields filled."""
    score = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.desc("filled"), tie)
    return rows.withColumn("filled", score).withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def canonical_documents(rows: DataFrame, group: list[str], title: Column, day: str, key: str) -> DataFrame:
    """The document that stands for each group: the notice, then its publication, others, republications; then the earliest."""
    t = F.lower(title)
    role = F.when(t.rlike("republic"), "republication").when(t.rlike("public"), "publication").when(t.rlike("edital|notice"), "notice").otherwise("other")
    rank = F.when(F.col("role") == "notice", 0).when(F.col("role") == "publication", 1).when(F.col("role") == "other", 2).otherwise(3)
    w = Window.partitionBy(*group)
    ranked = rows.withColumn("role", role).withColumn("_at", F.row_number().over(w.orderBy(rank, day, key))).withColumn("n_documents", F.count("*").over(w))
    return ranked.filter("_at = 1").select(*group, key, "role", "n_documents")


def quarantined(items: DataFrame, process_total: str, value: str, ceiling: float) -> DataFrame:
    """status of items against their process: quarantine, context (the process states no value) or release."""
    v, p = F.col(value), F.col(process_total)
    status = F.when((v > ceiling) | ((p > 0) & (v > 1.05 * p)), "quarantine").when(F.coalesce(p, F.lit(0)) == 0, "context").otherwise("release")
    return items.withColumn("status", status)


def nested_votes(sessions: DataFrame, votes: DataFrame, rolls: DataFrame, session: str, vote: str) -> DataFrame:
    """Each session with its votes and their roll calls, as one row: the number of votes and a digest of who chose what."""
    said = rolls.groupBy(vote).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "choice"))), ",").alias("choices"))
    joined = votes.join(said, vote, "left").groupBy(session).agg(F.count("*").alias("n_votes"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", vote, F.coalesce("choices", F.lit(""))))), ";")).alias("digest"))
    return sessions.join(joined, session, "left").select(session, F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "digest")


def by_sphere(rows: DataFrame, year: int) -> DataFrame:
    """Per sphere: the sum of one year, of all years, and of rows without a year, which the sum of all years leaves out."""
    v = F.col("value")
    part = lambda c: F.coalesce(F.sum(F.when(c, v)), F.lit(0).cast("decimal(18,2)")).cast("double")
    y = F.col("year")
    return rows.groupBy("sphere").agg(part(y == year).alias("of_year"), part(y.isNotNull()).alias("accumulated"), part(y.isNull()).alias("without_year"))


def coauthors(rows: DataFrame, key: str, names: Column) -> DataFrame:
    """Author and coauthor of each proposition; one with a single author has none."""
    each = rows.select(key, F.explode(F.array_distinct(names)).alias("author"))
    other = each.withColumnRenamed("author", "coauthor")
    return each.join(other, key).filter("author <> coauthor")  # authors of one proposition are few
