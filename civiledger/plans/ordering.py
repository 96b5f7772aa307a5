"""Rankings, windows, sequences, sets and incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quality, windows
from ..sources.tables import ledger, table
from ..streaming import jobs
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
_ORDINARY = "kind NOT ILIKE 'P%' AND kind NOT ILIKE 'O%'"


@_R.add(f"""
SELECT fiscal_year, payee_id, total, share_percent, CAST(rank AS INT) AS rank FROM (SELECT fiscal_year, payee_id, CAST(v AS DOUBLE) AS total,
 floor(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY fiscal_year) AS DOUBLE) * 10000 + 0.5) / 100 AS share_percent, row_number() OVER (PARTITION BY fiscal_year ORDER BY v DESC, payee_id) AS rank
 FROM (SELECT fiscal_year, payee_id, sum(value) AS v FROM {LEDGER} WHERE {_ORDINARY} GROUP BY ALL)) WHERE rank <= 10""")
def payee_ranking_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payees with most ordinary spending a year and their shares of it: a top-10 report."""
    from ..operators.spend import is_ordinary

    sums = ledger(spark, sf_dir).filter(is_ordinary(F.col("kind"))).groupBy("fiscal_year", "payee_id").agg(F.sum("value").alias("v"))
    share = F.col("v").cast("double") / F.sum("v").over(Window.partitionBy("fiscal_year")).cast("double")
    rows = sums.withColumn("share_percent", F.floor(share * 10_000 + 0.5) / 100)
    return windows.top_n(rows, ["fiscal_year"], 10, F.desc("v"), F.col("payee_id")).select("fiscal_year", "payee_id", F.col("v").cast("double").alias("total"), "share_percent", "rank")


@_R.add(f"SELECT payee_id, CAST(sum(value) AS DOUBLE) AS total, count(*) AS n FROM {LEDGER} GROUP BY payee_id ORDER BY sum(value) DESC, payee_id LIMIT 20 OFFSET 40")
def payee_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty payees."""
    sums = ledger(spark, sf_dir).groupBy("payee_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return sums.orderBy(F.desc("v"), "payee_id").offset(40).limit(20).select("payee_id", F.col("v").cast("double").alias("total"), "n")


@_R.add(f"""
SELECT n_name, c_custkey, total, CAST(rank AS INT) AS rank FROM (SELECT n_name, c_custkey, CAST(v AS DOUBLE) AS total, row_number() OVER (PARTITION BY n_name ORDER BY v DESC, c_custkey) AS rank
 FROM (SELECT n_name, c_custkey, sum(value) AS v FROM {LEDGER} JOIN customer ON payee_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE rank <= 3""")
def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = ledger(spark, sf_dir).groupBy("payee_id").agg(F.sum("value").alias("v"))
    names = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = paid.join(names, F.col("payee_id") == F.col("c_custkey")).select("n_name", "c_custkey", "v")
    return windows.top_n(rows, ["n_name"], 3, F.desc("v"), F.col("c_custkey")).select("n_name", "c_custkey", F.col("v").cast("double").alias("total"), "rank")


@_R.add(f"""
SELECT payee_id, string_agg(unit || ':' || CAST(n AS VARCHAR), ',' ORDER BY rank) AS mix FROM (SELECT *, row_number() OVER (PARTITION BY payee_id ORDER BY v DESC, unit) AS rank
 FROM (SELECT payee_id, unit, count(*) AS n, sum(value) AS v FROM {LEDGER} GROUP BY ALL)) WHERE rank <= 3 GROUP BY payee_id""")
def top3_mix_per_payee(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).groupBy("payee_id", "unit").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    top = windows.top_n(rows, ["payee_id"], 3, F.desc("v"), F.col("unit"))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "unit", F.col("n").cast("string")).alias("s"))))
    return top.groupBy("payee_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ",").alias("mix"))


@_R.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.latest_row(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_type", "event_id", "value")


_DAYS = "(SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL)"


@_R.add(f"""
SELECT event_type, day, n, (s - n) / (c - 1) AS others_mean FROM (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS s, count(*) OVER w AS c FROM {_DAYS} WINDOW w AS (PARTITION BY event_type))
WHERE c > 1 AND n >= 1.05 * (s - n) / (c - 1)""")
def leave_one_out_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return windows.leave_one_out_peaks(days, ["event_type"], "n", 1.05, 1)


@_R.add("""
SELECT p_type, l_suppkey, CAST(v AS DOUBLE) AS total, floor(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY p_type) AS DOUBLE) * 1000000 + 0.5) / 10000 AS share_percent
FROM (SELECT p_type, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = lines.groupBy("p_type", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    share = F.col("v").cast("double") / F.sum("v").over(Window.partitionBy("p_type")).cast("double")
    return sums.select("p_type", "l_suppkey", F.col("v").cast("double").alias("total"), (F.floor(share * 1_000_000 + 0.5) / 10_000).alias("share_percent"))


_NUMBERS = f"(SELECT DISTINCT fiscal_year, payee_id AS number FROM {LEDGER})"


@_R.add(f"""
SELECT fiscal_year, before, after, unnest(range(before + 1, after)) AS missing FROM (SELECT fiscal_year, number AS before, lead(number) OVER (PARTITION BY fiscal_year ORDER BY number) AS after FROM {_NUMBERS})
WHERE after > before + 1""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers missing from each year's series."""
    return windows.missing_numbers(ledger(spark, sf_dir).withColumnRenamed("payee_id", "number"), ["fiscal_year"], "number")


@_R.add("""
WITH s AS (SELECT user_id, epoch(date_trunc('second', ts)) AS a, epoch(date_trunc('second', ts)) + 3600 AS b FROM events),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, CAST(island AS BIGINT) AS island, CAST(min(a) AS BIGINT) AS island_start, CAST(max(b) AS BIGINT) AS island_end, count(*) AS n_spans FROM i GROUP BY user_id, island""")
def merged_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("a"))
    return windows.merged_islands(spans.withColumn("b", F.col("a") + 3600), ["user_id"], "a", "b")


@_R.add()
def greedy_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.greedy_forward_windows(ledger(spark, sf_dir), "payee_id", "entry_date", "value", 90, 3, 300_000.0)


@_R.add(f"""
WITH d AS (SELECT unit, entry_date, sum(value) AS v FROM {LEDGER} GROUP BY ALL),
w AS (SELECT a.unit, a.entry_date AS s, CAST(a.entry_date + INTERVAL 3 MONTH AS DATE) AS e, sum(b.v) AS t FROM d a JOIN d b ON a.unit = b.unit AND b.entry_date BETWEEN a.entry_date AND a.entry_date + INTERVAL 3 MONTH GROUP BY ALL)
SELECT unit, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end", CAST(t AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t DESC, s) AS r FROM w) WHERE r = 1""")
def best_n_month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ledger(spark, sf_dir).groupBy("unit", "entry_date").agg(F.sum("value").alias("v"))
    best = windows.best_month_window(daily, "unit", "entry_date", "v", 3)
    return best.select("unit", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.col("total").cast("double").alias("total"))


@_R.add(f"""
SELECT payee_id, this_year, last_year FROM (SELECT payee_id, CAST(sum(CASE WHEN fiscal_year = 2001 THEN value ELSE 0 END) AS DOUBLE) AS this_year, CAST(sum(CASE WHEN fiscal_year = 2000 THEN value ELSE 0 END) AS DOUBLE) AS last_year
FROM {LEDGER} WHERE strftime(entry_date, '%m-%d') <= (SELECT max(strftime(entry_date, '%m-%d')) FROM {LEDGER} WHERE fiscal_year = 2001) GROUP BY payee_id) WHERE last_year > 0 AND this_year >= 1.3 * last_year AND this_year - last_year >= 20000""")
def same_period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumn("day", F.date_format("entry_date", "MM-dd"))
    last = rows.filter("fiscal_year = 2001").agg(F.max("day").alias("last"))
    zero = F.lit(0).cast("decimal(18,2)")
    of = lambda y: F.sum(F.when(F.col("fiscal_year") == y, F.col("value")).otherwise(zero)).cast("double")
    sums = rows.join(F.broadcast(last), F.col("day") <= F.col("last")).groupBy("payee_id").agg(of(2001).alias("this_year"), of(2000).alias("last_year"))
    return sums.filter("last_year > 0 AND this_year >= 1.3 * last_year AND this_year - last_year >= 20000")


@_R.add("SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'purchase')")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select("user_id").union(e.filter("event_type = 'purchase'").select("user_id")).distinct()


@_R.add("SELECT section, count(*) AS n FROM (SELECT 'order' AS section FROM orders UNION ALL SELECT 'customer' FROM customer) GROUP BY section")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "orders").select(F.lit("order").alias("section"))
    return one.unionByName(table(spark, sf_dir, "customer").select(F.lit("customer").alias("section"))).groupBy("section").agg(F.count("*").alias("n"))


@_R.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@_R.add("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@_R.add("""
SELECT user_id, event_type, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC, event_id DESC) AS r FROM (
 SELECT user_id, event_type, event_id, value AS v, 0 AS version FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT user_id, event_type, event_id, value + 1, 1 FROM events WHERE event_id % 3 = 0)) WHERE r = 1""")
def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and a batch of newer rows, here every third event, by natural key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value").alias("v"))
    old, new = e.filter("event_id % 3 <> 0").withColumn("version", F.lit(0)), e.filter("event_id % 3 = 0").select("user_id", "event_type", "event_id", (F.col("v") + 1).alias("v"), F.lit(1).alias("version"))
    return jobs.upserted(old, new, ["user_id", "event_type"], F.desc("version"), F.desc("event_id")).drop("version")


@_R.add("""
SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.event_id IS NULL THEN 'inserted' WHEN b.event_id IS NULL THEN 'deleted' WHEN a.value = b.value THEN 'unchanged' ELSE 'updated' END AS change
FROM (SELECT * FROM events WHERE event_id % 10 <> 0) a FULL JOIN (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 9 <> 0) b USING (event_id)) GROUP BY change""")
def hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a table, made from the events: some rows gone, some new, some changed."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    old, new = e.filter("event_id % 10 <> 0"), e.filter("event_id % 9 <> 0").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return quality.changes(old, new, "event_id").groupBy("change").agg(F.count("*").alias("n"))


@_R.add("SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type")
def watermark_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.increment(table(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


@_R.add("""
WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) >= 100 AS done FROM events GROUP BY 1), s AS (SELECT min(day) AS stop FROM d WHERE NOT done)
SELECT max(day) AS done_until, count(*) AS n_done FROM d, s WHERE stop IS NULL OR day < stop""")
def contiguous_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg((F.count("*") >= 100).alias("done"))
    return jobs.contiguous_progress(days, "day", "done")


def _times(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("window", "session_window", "total")]
    w = "window" if "window" in rows.columns else "session_window"
    total = [F.col("total").cast("double").alias("total")] if "total" in rows.columns else []
    return rows.select(F.unix_timestamp(F.col(f"{w}.start")).alias("start_s"), F.unix_timestamp(F.col(f"{w}.end")).alias("end_s"), *rest, *total)


@_R.add("SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, CAST(floor(epoch(ts) / 3600) * 3600 + 3600 AS BIGINT) AS end_s, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(jobs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour"))


@_R.add("""
SELECT s AS start_s, s + 7200 AS end_s, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (
 SELECT *, CAST(floor(epoch(ts) / 3600) * 3600 - k * 3600 AS BIGINT) AS s FROM events, (VALUES (0), (1)) v(k)) GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(jobs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "2 hours", "1 hour"))


@_R.add("""
WITH n AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) + 1800 AS BIGINT) AS end_s, user_id, count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(jobs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes"))


@_R.add()
def anchored_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.anchored_buckets(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", 6 * 3600)


@_R.add("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 3 END AS tier FROM orders ORDER BY tier, o_orderdate, o_orderkey LIMIT 200")
def priority_tier_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded queue of 200, by tier, then oldest first."""
    p = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").withColumn("tier", F.when(p.startswith("1"), 1).when(p.startswith("2"), 2).otherwise(3))
    return rows.orderBy("tier", "o_orderdate", "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority", "tier")


@_R.add(f"SELECT day, entry_id FROM (SELECT CAST(entry_date AS VARCHAR) AS day, entry_id, row_number() OVER (PARTITION BY entry_date ORDER BY entry_id DESC) AS r, dense_rank() OVER (ORDER BY entry_date DESC) AS d FROM {LEDGER}) WHERE r = 1 AND d <= 7")
def retention_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each of the last seven days."""
    rows = ledger(spark, sf_dir)
    days = rows.select("entry_date").distinct().orderBy(F.desc("entry_date")).limit(7)
    picked = windows.latest_row(rows.join(F.broadcast(days), "entry_date"), ["entry_date"], F.desc("entry_id"))
    return picked.select(F.col("entry_date").cast("string").alias("day"), "entry_id")
