"""Filters, sorts, pages and write semantics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import filters
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(f"""
SELECT 'all' AS period, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM {LEDGER} UNION ALL SELECT 'year', count(*), CAST(sum(value) AS DOUBLE) FROM {LEDGER} WHERE fiscal_year = 1997
UNION ALL SELECT 'term', count(*), CAST(sum(value) AS DOUBLE) FROM {LEDGER} WHERE fiscal_year BETWEEN 1997 AND 2000 UNION ALL SELECT 'none', count(*), CAST(sum(value) AS DOUBLE) FROM {LEDGER} WHERE 1 = 0""")
def period_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year goes before a term; no period is no filter, an empty list of allowed ones is nothing."""
    year, out = F.col("fiscal_year"), None
    chosen = {"all": (None, True), "year": (keys.period_years(1997, 1997), True), "term": (keys.period_years(None, 1997), True), "none": ([], False)}
    for name, (years, empty) in chosen.items():
        rows = ledger(spark, sf_dir).filter(filters.in_list(year, years or [], empty))
        part = rows.agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total")).select(F.lit(name).alias("period"), "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


@_R.add("SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' 50%_A' ELSE '' END AS name FROM customer WHERE c_custkey % 3 = 0 OR c_custkey = 7")
def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with signs of patterns are found as they stand, and one by its key."""
    name = F.expr("c_name || CASE WHEN c_custkey % 3 = 0 THEN ' 50%_A' ELSE '' END")
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), F.when(F.col("c_custkey") == 7, "pf-50-a").alias("key"))
    return rows.filter(filters.contains_name(F.col("name"), F.col("key"), "50%_a")).select("c_custkey", "name")


_REASON = "CASE WHEN c_custkey % 5 = 0 THEN 'person' WHEN c_custkey % 7 = 0 THEN 'payroll' WHEN c_custkey % 11 = 0 THEN 'utility' WHEN c_custkey % 13 = 0 THEN 'tax' END"


@_R.add(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM customer GROUP BY 1")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.expr("CASE WHEN c_custkey % 5 = 0 THEN '123.456' ELSE lpad(CAST(c_custkey AS STRING), 14, '1') END")
    name = F.expr("c_name || CASE WHEN c_custkey % 7 = 0 THEN ' Folha de Pagamento' WHEN c_custkey % 11 = 0 THEN ' ENERGIA' WHEN c_custkey % 13 = 0 THEN ' PASEP' ELSE '' END")
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(filters.exclusion_reason(tax, name), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@_R.add("""
SELECT p_size % 4 + 1 AS level, count(*) AS n FROM part WHERE p_size % 4 < 2 GROUP BY 1""")
def code_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the first two levels; segments of zeros at the end do not count."""
    code = F.expr("'1' || repeat('.2', p_size % 4) || CASE WHEN p_partkey % 2 = 0 THEN '.00.0' ELSE '' END")
    rows = table(spark, sf_dir, "part").select(filters.code_level(code).alias("level"))
    return rows.filter("level <= 2").groupBy(F.col("level").cast("bigint").alias("level")).agg(F.count("*").alias("n"))


@_R.add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) = 1998 OR (l_tax > 0.04 AND year(l_shipdate) + 1 = 1998)")
def either_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    instrument = F.when(F.col("l_tax") > 0.04, F.year("l_shipdate") + 1)
    return table(spark, sf_dir, "lineitem").filter(filters.either_year(instrument, F.col("l_shipdate"), 1998)).select("l_orderkey", "l_linenumber")


_UNPAID = "lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' AND l_linenumber > 1"


@_R.add(f"SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM {_UNPAID}) AS n_all, (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) FROM {_UNPAID}) AS total FROM {_UNPAID} ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber LIMIT 200")
def unpaid_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 oldest that are settled and not paid, and totals of all."""
    settled, paid = F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    kind = F.when(F.col("l_linenumber") == 1, "pe").otherwise(None)
    rows = table(spark, sf_dir, "lineitem").filter(filters.unpaid(settled, paid, kind)).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    oldest, totals = filters.oldest_first(rows, "l_shipdate", "k", 200, [F.count("*").alias("n_all"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total")])
    return oldest.select("l_orderkey", "l_linenumber").join(F.broadcast(totals), F.lit(True))  # one row


@_R.add("""
SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) AND p_partkey % 9 > 0 AND p_size > 5 AND p_retailprice > 0 AND p_name NOT LIKE '%steel%'""")
def eligible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items fit for price comparison: not in quarantine, of ordinary entries, with size and price, and not bespoke."""
    bad = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    rows = table(spark, sf_dir, "part").filter((F.col("p_partkey") % 9 > 0) & (F.col("p_size") > 5) & (F.col("p_retailprice") > 0) & ~F.col("p_name").contains("steel"))
    return rows.join(bad, "p_partkey", "left_anti").select("p_partkey", "p_size", "p_brand")


@_R.add("SELECT c_custkey, c_mktsegment AS department FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey = 3 AND c_acctbal > 0")
def payroll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several filters at once; a department stands for its aliases."""
    aliases = {"works": ["BUILDING", "MACHINERY"]}
    c = F.col
    rows = table(spark, sf_dir, "customer").filter(filters.in_list(c("c_mktsegment"), aliases["works"], True) & (c("c_nationkey") == 3) & (c("c_acctbal") > 0) & filters.in_list(c("c_custkey"), [], True))
    return rows.select("c_custkey", c("c_mktsegment").alias("department"))


@_R.add("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100""")
def flexible_date_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'sem data' WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'yyyy-MM-dd') || 'T00:00' END")
    top = table(spark, sf_dir, "orders").select("o_orderkey", filters.flexible_date_key(raw).alias("k")).orderBy(F.desc("k"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("k"), "o_orderkey")).cast("bigint").alias("place"))  # of the 100 on top


@_R.add("""
SELECT p_partkey, count(*) OVER () AS n_all FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'lote' ELSE (p_partkey % 100) || 'A' END AS lot, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 100 END AS k FROM part) ORDER BY k, lot, p_partkey LIMIT 30 OFFSET 60""")
def numeric_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of lots, by number, then by text, with the number of all."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'lote' ELSE (p_partkey % 100) || 'A' END").alias("lot"))
    return filters.page(rows, [*filters.numeric_then_text(F.col("lot")), "p_partkey"], 3, 30).select("p_partkey", "n_all")


@_R.add("SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS place FROM nation")
def locale_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By folded name, so accents and capitals do not part what belongs together."""
    from pyspark.sql import Window

    from ..functions.text import fold_lower

    name = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN translate(n_name, 'AEIO', 'ÁÉÍÓ') ELSE lower(n_name) END")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", fold_lower(name).alias("k"))
    return rows.select("n_nationkey", F.row_number().over(Window.orderBy("k", "n_nationkey")).cast("bigint").alias("place"))


@_R.add("""
WITH s AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS wins FROM lineitem GROUP BY 1)
SELECT 'value' AS ordered_by, l_suppkey FROM (SELECT * FROM s ORDER BY value DESC, l_suppkey LIMIT 10) UNION ALL SELECT 'wins', l_suppkey FROM (SELECT * FROM s ORDER BY wins DESC, l_suppkey LIMIT 10)""")
def supplier_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first suppliers by either order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("value"), F.count("*").alias("wins"))
    top = lambda by: rows.orderBy(F.desc(by), "l_suppkey").limit(10).select(F.lit(by).alias("ordered_by"), "l_suppkey")
    return top("value").unionByName(top("wins"))


@_R.add()
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entries of each year and kind, drawn by a seed."""
    return filters.random_sample(ledger(spark, sf_dir), ["fiscal_year", "kind"], "entry_id", 5, 42).select("fiscal_year", "kind", "entry_id")


@_R.add("SELECT o_orderkey, substr(o_orderpriority, 1, 6) AS text FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 rows after a key, their text cut."""
    return filters.after_key(table(spark, sf_dir, "orders"), "o_orderkey", 500, 50).select("o_orderkey", F.substring("o_orderpriority", 1, 6).alias("text"))


@_R.add("""
WITH b AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS z FROM orders GROUP BY 1)
SELECT o_custkey, CAST(s AS VARCHAR) AS window_start, CAST(least(CAST(s AS DATE) + 6, z) AS VARCHAR) AS window_end FROM (SELECT o_custkey, z, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS s FROM b)""")
def date_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a week between each payee's first and last entry."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("z"))
    each = rows.select("o_custkey", F.explode(filters.date_windows(F.col("a"), F.col("z"))).alias("w"))
    return each.select("o_custkey", F.col("w.start").cast("string").alias("window_start"), F.col("w.end").cast("string").alias("window_end"))


@_R.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS value FROM events WHERE event_id % 3 > 0 OR event_id % 2 = 0")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    new = e.filter("event_id % 3 > 0").withColumn("value", F.col("value") + 1)
    return filters.inserted_if_absent(e.filter("event_id % 2 = 0"), new.union(new), "event_id")


@_R.add("""
SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber < 3) UNION ALL SELECT l_orderkey, l_linenumber + 100 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber < 3) GROUP BY 1""")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every third order come anew, fewer of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    new = rows.filter("l_orderkey % 3 = 0 AND l_linenumber < 3").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    out = filters.replaced_children(rows, new, "l_orderkey")
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("numbers"))


@_R.add(f"SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN payee_id WHEN entry_id % 3 = 0 THEN -1 END AS winner, entry_id % 2 = 1 AND entry_id % 3 = 0 AS was_set FROM {LEDGER}")
def set_where_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    old = rows.select("entry_id", F.when(F.col("entry_id") % 2 == 0, F.col("payee_id")).alias("winner"))
    return filters.set_where_null(old, rows.filter("entry_id % 3 = 0").select("entry_id", F.lit(-1).cast("bigint").alias("winner")), "entry_id", "winner")


@_R.add(f"""
SELECT entry_id, CASE WHEN NOT hide THEN CAST(value AS DOUBLE) END AS value FROM (SELECT entry_id, value, x IS NOT NULL AND kind <> 'F' AND max(CASE WHEN kind = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY x) = 1 AS hide
FROM (SELECT *, CASE WHEN entry_id % 4 > 0 THEN payee_id END AS x FROM {LEDGER}))""")
def neutralised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that share an external id with a closed one lose their value."""
    rows = ledger(spark, sf_dir).select("entry_id", "kind", F.col("value").cast("double").alias("value"), F.when(F.col("entry_id") % 4 > 0, F.col("payee_id")).alias("external"))
    return filters.neutralised(rows, "external", F.col("kind") == "F", ["value"]).select("entry_id", "value")


@_R.add("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'old' ELSE 'new' END AS class, CAST(2 AS INT) AS version FROM events")
def versioned_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the version before are computed anew."""
    e = table(spark, sf_dir, "events").select("event_id")
    old = e.select("event_id", F.lit("old").alias("class"), F.when(F.col("event_id") % 8 == 0, None).when(F.col("event_id") % 4 == 0, 1).otherwise(2).alias("version"))
    return filters.versioned_recompute(old, e.select("event_id", F.lit("new").alias("class"), F.lit(2).alias("version")), "event_id", "version", 2)


@_R.add("""
SELECT lang, source, doc_id FROM (SELECT *, sum(n_chars) OVER (PARTITION BY lang, source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE spent <= 20000 OR k = 1""")
def budgeted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the documents that one run may take, by characters."""
    return filters.budgeted(table(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"], F.col("n_chars"), 20_000).select("lang", "source", "doc_id")
