"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clustering, search, vector_store
from ..sources.tables import table
from .indexes import kept_index
from .registering import Registry

_R = Registry()
QUERIES, ORACLES = _R.queries, _R.oracles
TERMS = ["tion", "thing", "ment", "ando"]
PREFIXES = ["the", "ing", "eres"]
#: Postings in SQL.
_INDEX = """
words AS (SELECT doc_id AS doc, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY ALL), idx AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY doc) AS BIGINT) AS doc_length FROM tf)"""


@_R.add(f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM idx GROUP BY term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the kept index."""
    return kept_index(spark, sf_dir).vocabulary()


_BM25 = """
size AS (SELECT count(*) AS n, avg(doc_length) AS a FROM (SELECT DISTINCT doc, doc_length FROM idx)),
hit AS (SELECT * FROM idx WHERE term IN ('tion', 'thing', 'ment', 'ando')), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_length / a))) AS score FROM hit JOIN df USING (term), size GROUP BY doc)"""


@_R.add(f"WITH {_INDEX}, {_BM25} SELECT doc, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents, from the kept index."""
    return kept_index(spark, sf_dir).bm25(TERMS).select("doc", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(50)


@_R.add(f"""
WITH {_INDEX} SELECT doc, CAST(sum(tf) AS BIGINT) AS hits FROM idx, (VALUES ('the'), ('ing'), ('eres')) p(prefix) WHERE starts_with(term, prefix) GROUP BY doc HAVING count(DISTINCT prefix) = 3""")
def prefix_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).prefix_and(PREFIXES).select("doc", "hits")


@_R.add()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), PREFIXES).alias("snippet"))
    return docs.filter("snippet IS NOT NULL")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.round("score", 4).alias("score"))


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"


@_R.add(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings, {_Q}) ORDER BY s DESC, vec_id LIMIT 10")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors."""
    return _rounded(search.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10))


@_R.add(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, {_COS} AS s FROM embeddings, {_Q} WHERE label IN (1, 3)) ORDER BY s DESC, vec_id LIMIT 10")
def prefiltered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors with one of two labels."""
    return _rounded(search.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 10, F.col("label").isin(1, 3)))


_INT8 = "list_transform(CAST({0} AS DOUBLE[]), lambda x: floor(x * 127 / list_max(list_transform(CAST({0} AS DOUBLE[]), lambda y: abs(y))) + 0.5))"


@_R.add(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, list_cosine_similarity({_INT8.format('embedding')}, {_INT8.format('q')}) AS s FROM embeddings, {_Q}) ORDER BY round(s, 6) DESC, vec_id LIMIT 10")
def int8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by their 8-bit forms."""
    rows = table(spark, sf_dir, "embeddings")
    q = rows.filter("vec_id = 0").select(search.quantised(F.col("embedding")).alias("q")).first()[0]
    # quantised once a row: norm and product read the bound array
    score = F.transform(F.array(search.quantised(F.col("embedding"))), lambda v: search.cosine(v, F.array(*[F.lit(x) for x in q])))[0]
    near = rows.select("vec_id", F.round(score, 6).alias("score"))
    return near.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", F.round("score", 4).alias("score"))


_RANKS = "l AS (SELECT doc, row_number() OVER (ORDER BY round(score, 6) DESC, doc) AS rank FROM bm ORDER BY rank LIMIT 50), v AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS s FROM embeddings, " + _Q + ") ORDER BY rank LIMIT 50)"


def _ranked(top: DataFrame, by: str) -> DataFrame:
    """Ranks of a branch's few candidates."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "doc"))).select("doc", "rank")


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lexical = _ranked(bm25_topk(spark, sf_dir), "score")
    near = search.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir), 60).select(F.col("vec_id").alias("doc"), F.round("score", 9).alias("score"))
    return lexical, _ranked(near, "score").filter("rank <= 50")


@_R.add(f"WITH {_INDEX}, {_BM25}, {_RANKS} SELECT doc, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY doc")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.reciprocal_rank_fusion(*_branches(spark, sf_dir)).select("doc", F.round("score", 8).alias("score"))


@_R.add()
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both branches fused, cut to a context budget of 12,000 characters."""
    fused = search.reciprocal_rank_fusion(*_branches(spark, sf_dir))
    ranked = _ranked(fused.orderBy(F.desc("score"), "doc").limit(20), "score").join(fused, "doc")
    rows = ranked.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return search.context_budget(rows, "score", "text", "rank", 0.0, 12_000).select("doc", "rank", F.round("score", 8).alias("score"))


@_R.add("""
WITH w AS (SELECT item_id, doc_id, list_distinct(list_filter(string_split_regex(lower(strip_accents(b.text)), '[^a-z0-9]+'), lambda w: length(w) >= 8)) AS y,
  list_distinct(list_filter(string_split_regex(lower(strip_accents(d.text)), '[^a-z0-9]+'), lambda w: length(w) >= 8)) AS x, contains(d.text, b.text) AS rel FROM benchmark b, documents d),
r AS (SELECT item_id, doc_id, rel, len(list_intersect(x, y)) AS s FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM r WHERE s > 0),
q AS (SELECT item_id, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS recall, coalesce(1.0 / min(rank), 0) AS rr FROM (SELECT item_id, doc_id FROM r WHERE rel) LEFT JOIN k USING (item_id, doc_id) GROUP BY item_id)
SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM q""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well shared long words find the documents that hold a benchmark item."""
    from ..functions.text import tokens
    from ..operators.windows import top_n

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    d = docs.select(F.col("doc_id").alias("doc"), F.explode(tokens(F.col("text"), 8)).alias("w"))
    i = items.select(F.col("item_id").alias("query"), F.explode(tokens(F.col("text"), 8)).alias("w"))
    shared = d.join(i, "w").groupBy("query", "doc").agg(F.count("*").alias("s"))
    results = shared.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "doc"))).select("query", "doc", "rank")
    # a text that holds an item has its inner words: of three of them at most two are cut at its ends
    df = d.groupBy("w").agg(F.count("*").alias("df"))
    rare = i.join(df, "w").groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), 1, 3).alias("r")).select("query", F.explode("r.w").alias("w"))
    candidates = d.join(rare, "w").select("query", "doc").distinct()
    texts = candidates.join(items.select(F.col("item_id").alias("query"), F.col("text").alias("item")), "query").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    relevant = texts.filter(F.contains("text", "item")).select("query", "doc")
    out = search.retrieval_quality(results, relevant, 10)
    return out.select("n_queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@_R.add()
def greedy_embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each label in order of id: each joins the nearest centre before it that is alike to 0.6, or becomes one."""
    rows = table(spark, sf_dir, "embeddings").withColumn("weight", F.lit(1.0))
    return clustering.greedy_clusters(rows, "label", "vec_id", "embedding", "weight", 0.6).drop("similarity")


@_R.add()
def product_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct descriptions of parts, the most frequent first, clustered by their hashed words."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    named = clustering.weighted_descriptions(parts, "text")
    vectors = vector_store.hashed_embedding(named, "description", "description", 64).withColumn("all", F.lit(0))
    return clustering.greedy_clusters(vectors.join(named, "description"), "all", "description", "vector", "weight", 0.6).join(named, "description").select("description", "centre", "weight")


@_R.add("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm, len(embedding) AS dims FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(search.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").cast("bigint").alias("dims"))
