"""Joins: equi, semi, anti, outer, as-of, ranges, crosswalks and likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_lower, overlap, tokens
from ..operators import linkage
from ..sources.tables import ledger, table
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
STEPS = [(1995, 150_000.0), (1998, 160_000.0), (2000, 180_000.0)]


@_R.add(f"SELECT entry_id, c_name, c_mktsegment FROM {LEDGER} JOIN customer ON payee_id = c_custkey WHERE fiscal_year = 1998")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).filter("fiscal_year = 1998")
    return rows.join(table(spark, sf_dir, "customer"), F.col("payee_id") == F.col("c_custkey")).select("entry_id", "c_name", "c_mktsegment")


@_R.add("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@_R.add("SELECT n_name, r_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def multiway_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@_R.add("SELECT p_partkey, p_type FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50")
    return table(spark, sf_dir, "part").join(big, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_type")


@_R.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@_R.add("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.col("hit").isNotNull().alias("labelled"))


@_R.add("""
WITH a AS (SELECT l_suppkey AS k, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT s_suppkey AS k, s_nationkey FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(a.k, b.k) AS supplier, coalesce(n_lines, 0) AS n_lines, coalesce(n_orders, 0) AS n_orders, s_nationkey FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))
    own = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier"), "s_nationkey")
    return lines.join(own, "supplier", "full_outer").select("supplier", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "s_nationkey")


@_R.add(f"""
SELECT entry_id, CAST(CASE WHEN fiscal_year < 1998 THEN 150000 WHEN fiscal_year < 2000 THEN 160000 ELSE 180000 END AS DOUBLE) AS threshold, fiscal_year < 1995 OR fiscal_year > 2000 AS extrapolated
FROM {LEDGER} WHERE value > CASE WHEN fiscal_year < 1998 THEN 150000 WHEN fiscal_year < 2000 THEN 160000 ELSE 180000 END""")
def as_of_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.as_of(ledger(spark, sf_dir), "fiscal_year", STEPS).filter(F.col("value") > F.col("threshold")).select("entry_id", "threshold", "extrapolated")


@_R.add("""
WITH s AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('error', 'signup')),
p AS (SELECT event_type, user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b, count(DISTINCT CAST(ts AS DATE)) AS present FROM events GROUP BY ALL)
SELECT event_type, user_id, count(*) AS expected, max(present) AS present FROM s JOIN p USING (event_type) WHERE day BETWEEN a AND b GROUP BY ALL""")
def range_containment_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session days within each person's first and last day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = e.filter(F.col("event_type").isin("error", "signup")).select("event_type", "day").distinct()
    people = e.groupBy("event_type", "user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.countDistinct("day").alias("present"))
    rows = linkage.range_containment(days, people, "event_type", "day", "a", "b")
    return rows.groupBy("event_type", "user_id").agg(F.count("*").alias("expected"), F.max("present").alias("present"))


@_R.add("""
WITH s AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('error', 'signup')),
p AS (SELECT event_type, user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b, count(DISTINCT CAST(ts AS DATE)) AS present FROM events GROUP BY ALL)
SELECT event_type, user_id, count(*) AS expected, max(present) AS present FROM s JOIN p USING (event_type) WHERE day BETWEEN a AND b GROUP BY ALL""")
def range_containment_attendance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session days within each person's first and last day, for everybody.

    Both days are session days themselves, so their numbers among all of them give the count.
    """
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("event_type").orderBy("day")
    days = e.select("event_type", "day").filter("day IS NOT NULL").distinct().withColumn("k", F.row_number().over(order))
    people = e.groupBy("event_type", "user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.countDistinct("day").alias("present"))
    first = days.select("event_type", F.col("day").alias("a"), F.col("k").alias("ka"))
    last = days.select("event_type", F.col("day").alias("b"), F.col("k").alias("kb"))
    rows = people.join(first, ["event_type", "a"]).join(last, ["event_type", "b"])
    return rows.select("event_type", "user_id", (F.col("kb") - F.col("ka") + 1).cast("bigint").alias("expected"), "present")


@_R.add("""
WITH p AS (SELECT lower(p_brand) || '|' || lower(p_type) || '|' || p_size AS k, min(p_partkey) AS p_partkey, count(*) > 1 AS ambiguous FROM part GROUP BY 1)
SELECT s.s_suppkey, p.p_partkey, k AS key, ambiguous FROM (SELECT s_suppkey, 'brand#' || (s_suppkey % 25) || '|economy|' || (s_suppkey % 40 + 1) AS k FROM supplier) s JOIN p USING (k)""")
def crosswalk_parsed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("|", F.concat(F.lit("brand#"), F.col("s_suppkey") % 25), F.lit("economy"), F.col("s_suppkey") % 40 + 1).alias("key"))
    right = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", F.lower("p_brand"), F.lower("p_type"), "p_size").alias("key"))
    return linkage.crosswalk(left, right, "key", "s_suppkey", "p_partkey")


@_R.add("""
SELECT l_suppkey, any_value(p_partkey) AS p_partkey FROM (SELECT DISTINCT l_suppkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_retailprice > 1800 OR l_suppkey = p_partkey)
GROUP BY l_suppkey HAVING count(*) = 1""")
def collision_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers for whom exactly one candidate part remains."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).filter("p_retailprice > 1800 OR l_suppkey = p_partkey")
    return rows.groupBy("l_suppkey").agg(F.countDistinct("p_partkey").alias("n"), F.min("p_partkey").alias("p_partkey")).filter("n = 1").drop("n")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(strip_accents({0})), '[^a-z0-9]+'), lambda w: length(w) >= {1}))"


@_R.add(f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text", 5)} AS x FROM documents), b AS (SELECT item_id, {_WORDS.format("text", 5)} AS y FROM benchmark),
s AS (SELECT doc_id, item_id, CAST(floor(100.0 * len(list_intersect(x, y)) / least(len(x), len(y)) + 0.5) AS INT) AS score FROM d, b WHERE len(x) > 0 AND len(y) > 0)
SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s WHERE score >= 40) WHERE r = 1""")
def scored_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the item whose tokens they hold most of; candidates share a token."""
    return linkage.token_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 5, 40)


@_R.add()
def scored_fuzzy_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of any length with the item whose tokens they hold most of. A test compares it by brute force."""
    return linkage.token_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", 5, 40)


@_R.add("""
WITH k AS (SELECT doc_id, sha256(text) AS h, source || '|' || n_chars AS s FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, sha256(text) AS h, source || '|' || n_chars AS s FROM documents WHERE doc_id % 2 = 1),
a AS (SELECT h, min(doc_id) AS i FROM k GROUP BY h), b AS (SELECT s, min(doc_id) AS i FROM k GROUP BY s)
SELECT n.doc_id, coalesce(a.i, b.i) AS known_id, CASE WHEN a.i IS NOT NULL THEN 1 WHEN b.i IS NOT NULL THEN 2 END AS matched_by FROM n LEFT JOIN a USING (h) LEFT JOIN b USING (s)""")
def identity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly collected documents (odd ids) against known ones (even ids), by content, then by source and length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat_ws("|", "source", "n_chars").alias("s"))
    known = rows.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "known_id")
    return linkage.identity_cascade(rows.filter("doc_id % 2 = 1"), known, "doc_id", "known_id", ("h",), ("s",))


_SETS = f"(SELECT doc_id, {_WORDS.format('text', 1)} AS x FROM documents)"


@_R.add(f"""
SELECT a.doc_id AS a, b.doc_id AS b, floor(len(list_intersect(a.x, b.x)) / CAST(len(list_distinct(list_concat(a.x, b.x))) AS DOUBLE) * 10000 + 0.5) / 10000 AS score
FROM {_SETS} a JOIN {_SETS} b ON a.doc_id < b.doc_id AND len(a.x) > 0 AND 100 * least(len(a.x), len(b.x)) >= 75 * greatest(len(a.x), len(b.x))
WHERE 100 * len(list_intersect(a.x, b.x)) >= 75 * len(list_distinct(list_concat(a.x, b.x)))""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.jaccard_pairs(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 75)


@_R.add("SELECT o_orderkey, l_partkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS r FROM lineitem) ON l_orderkey = o_orderkey AND r = 1")
def latest_child_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = linkage.latest_child(table(spark, sf_dir, "orders"), lines, "o_orderkey", F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"))
    return out.select("o_orderkey", "l_partkey")


@_R.add("SELECT c_custkey, c_name FROM customer WHERE lower(strip_accents(c_name)) LIKE '%customer#00000001%' ")
def folded_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(fold_lower(F.col("c_name")).contains("customer#00000001")).select("c_custkey", "c_name")
