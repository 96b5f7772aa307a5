"""Rebuilt aggregates, resumed loads, upserts by stream and the kept vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector_store
from ..sources.scratch import scratch_path, stored
from ..sources.tables import ledger, table
from ..sources.versions import BucketedTable
from ..streaming import jobs, resume
from .registering import LEDGER, Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles


@_R.add(f"""
SELECT payee_id, count(*) AS n_entries, CAST(sum(value) AS DOUBLE) AS total, string_agg(DISTINCT fiscal_year, ',' ORDER BY fiscal_year) AS years FROM {LEDGER} GROUP BY payee_id""")
def rebuilt_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payee profiles, rebuilt as a whole over an older table; readers see the old version until the switch, and then it goes."""
    kept = BucketedTable(spark, scratch_path(spark, "profiles"), "payee_id bigint, n_entries bigint, total double, years string", ["payee_id"], 16)
    profiles = lambda rows: rows.groupBy("payee_id").agg(
        F.count("*").alias("n_entries"), F.sum("value").cast("double").alias("total"), F.array_join(F.array_sort(F.collect_set("fiscal_year")), ",").alias("years"))
    entries = ledger(spark, sf_dir)
    kept.replace(profiles(entries.withColumn("payee_id", -F.col("payee_id"))))  # keys of an older form
    kept.replace(profiles(entries))
    kept.files.vacuum()
    return kept.read()


class _Killed(RuntimeError):
    pass


@_R.add("""
WITH old AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 3 <> 0),
acts AS (SELECT CASE WHEN o.event_id IS NULL THEN 'inserted' WHEN o.value = e.value THEN 'unchanged' ELSE 'updated' END AS action FROM events e LEFT JOIN old o USING (event_id))
SELECT event_type AS what, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type
UNION ALL SELECT action, count(*), 0.0 FROM acts GROUP BY action""")
def resumed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load killed twice and resumed: the table it leaves, and how many rows it inserted, updated and left."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kept = BucketedTable(spark, scratch_path(spark, "loads"), "event_id bigint, event_type string, value double", ["event_id"], 16)
    kept.replace(events.filter("event_id % 3 <> 0").withColumn("value", F.expr("CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END")))

    def until(stop: int):
        def going_on(k: int) -> None:
            if k == stop:
                raise _Killed

        return going_on

    for stop in (1, 3):
        try:
            resume.resumed_load(kept, "events", lambda: events, lambda rows: rows, 4, until(stop))
        except _Killed:
            pass
    counts = resume.resumed_load(kept, "events", lambda: events.limit(0), lambda rows: rows, 4)  # the kept input counts, not what is read now
    acts = spark.createDataFrame([(a, n, 0.0) for a, n in counts.items() if n], "what string, n bigint, total double")
    return kept.read().groupBy(F.col("event_type").alias("what")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).unionByName(acts)


@_R.add("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def streamed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, merged into a bucketed table, then summed."""
    e = stored(table(spark, sf_dir, "events").select("event_id", "event_type", "value").repartition(2), "stream-source")
    source = e.inputFiles()[0].rsplit("/", 1)[0]
    root, schema = scratch_path(spark, "stream-target"), "event_id bigint, event_type string, value double"
    target = BucketedTable(spark, root, schema, ["event_id"], 16)
    resume.run_bucketed_upserts(jobs.stream_of(spark, source, schema), target, lambda: [F.desc("value")], f"{root}/checkpoint")
    return target.read().groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


_PIECES = "(SELECT vec_id AS id, vec_id // 4 AS doc, coalesce(source, 'none') AS url, coalesce(text, '') AS text, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    rows = table(spark, sf_dir, "embeddings").join(docs, "vec_id", "left")
    text = lambda c, or_: F.coalesce(c, F.lit(or_)).alias(c)
    return rows.select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("doc"), F.coalesce("source", F.lit("none")).alias("url"), text("text", ""), F.col("embedding").cast("array<double>").alias("vector"))


_BROKEN = "CASE WHEN vec_id % 11 = 0 THEN {cut} WHEN vec_id % 13 = 0 THEN {nan} WHEN vec_id % 17 = 0 THEN {zero} ELSE {vector} END"


@_R.add("WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 19 = 0 THEN ' ' ELSE 'http://a' END AS url, " + _BROKEN.format(cut="v[2:]", nan="list_transform(v, lambda x: CASE WHEN x > 0 THEN 'nan'::DOUBLE ELSE x END)", zero="list_transform(v, lambda x: 0.0::DOUBLE)", vector="v") + """ AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
r AS (SELECT id, CASE WHEN trim(url) = '' THEN 'address' WHEN len(v) <> 64 THEN 'length' WHEN len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'zero' END AS refused FROM p)
SELECT refused, count(*) AS n, min(id) AS first_id FROM r GROUP BY refused""")
def refused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store's check says of vectors that are cut, not finite or zero, and of pieces without an address."""
    vector = F.expr(_BROKEN.format(cut="slice(embedding, 2, 64)", nan="transform(embedding, x -> CASE WHEN x > 0 THEN double('nan') ELSE x END)", zero="transform(embedding, x -> 0.0D)", vector="embedding"))
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.select(F.col("vec_id").alias("id"), F.expr("CASE WHEN vec_id % 19 = 0 THEN ' ' ELSE 'http://a' END").alias("url"), vector.alias("vector"))
    return vector_store.checked(rows, 64).groupBy("refused").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_STORE = f"""
kept AS (SELECT * FROM {_PIECES} WHERE doc % 7 <> 0 AND (doc % 5 <> 0 OR id % 4 = 0)),
pieces AS (SELECT id, doc, text, CASE WHEN doc % 5 = 0 THEN list_transform(vector, lambda x: -x) ELSE vector END AS v FROM kept),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1)"""


def _changed_store(spark: SparkSession, sf_dir: str) -> vector_store.VectorStore:
    rows = stored(_pieces(spark, sf_dir), "pieces")
    store = vector_store.VectorStore(spark, scratch_path(spark, "vectors"), 64)
    store.replace_documents(rows)
    store.replace_documents(rows.filter("doc % 5 = 0 AND id % 4 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    store.delete_documents(rows.filter("doc % 7 = 0"))
    return store


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 1").select("embedding").first()[0]]


@_R.add(f"WITH {_STORE} SELECT id, doc, round(list_cosine_similarity(v, q), 6) AS score, (SELECT count(*) FROM pieces) AS n_pieces FROM pieces, q ORDER BY list_cosine_similarity(v, q) DESC, id LIMIT 20")
def vector_store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pieces after a fifth of the documents were replaced and a seventh deleted."""
    store = _changed_store(spark, sf_dir)
    return store.search(_probe(spark, sf_dir), 20).select("id", "doc", F.round("score", 6).alias("score"), F.lit(store.count()).cast("bigint").alias("n_pieces"))


@_R.add(f"""
WITH {_STORE}, w AS (SELECT id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM pieces), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL),
idx AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS l FROM tf), size AS (SELECT count(*) AS n, avg(l) AS a FROM (SELECT DISTINCT id, l FROM idx)),
hit AS (SELECT * FROM idx WHERE term IN ('ment', 'thing')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
lex AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS s FROM hit JOIN df USING (term), size GROUP BY id),
top AS (SELECT id FROM lex ORDER BY s DESC, id LIMIT 15)
SELECT id, doc, round(list_cosine_similarity(v, q), 6) AS score FROM top JOIN pieces USING (id), q""")
def lexical_by_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that two words find first, scored by cosine."""
    return _changed_store(spark, sf_dir).search_words("Ment thing", _probe(spark, sf_dir), 15).select("id", "doc", F.round("score", 6).alias("score"))


@_R.add("""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(string_split('a o as os um uma de da do das dos em no na nos nas para por com que e ou se foi ao aos qual quem quais', ' '), w))) AS word FROM documents),
h AS (SELECT word, list_reduce(list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261::BIGINT) % 256 AS dim FROM (SELECT DISTINCT word FROM w)),
c AS (SELECT doc_id, dim, count(*) AS n FROM w JOIN h USING (word) GROUP BY ALL)
SELECT doc_id, count(*) AS n_dims, min_by(dim, (-n, dim)) AS top_dim, round(max(n) / sqrt(sum(n * n)), 6) AS top_value FROM c GROUP BY doc_id""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of hashed words: how many dimensions each text has, and the greatest."""
    rows = vector_store.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    top = F.array_max("vector")
    return rows.select("doc_id", F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("n_dims"), (F.array_position("vector", top) - 1).alias("top_dim"), F.round(top, 6).alias("top_value"))
