"""Lexical, vector and hybrid retrieval, and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_lower, mask
from .scans import scan_sorted

K1, B, RRF = 1.2, 0.75, 60


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, term, tf, doc_length; documents are told apart by their key. The length is known before words are told apart, so one exchange is enough."""
    words = docs.select(F.col(key).alias("doc"), F.filter(F.split(fold_lower(F.col(text)), "[^a-z0-9]+"), lambda w: F.length(w) > 0).alias("words"))
    words = words.select("doc", F.size("words").cast("bigint").alias("doc_length"), F.explode("words").alias("term"))
    return words.groupBy("doc", "term", "doc_length").agg(F.count("*").alias("tf")).select("doc", "term", "tf", "doc_length")


def bm25(index: DataFrame, terms: list[str], n_docs: Column | int, average: Column | float) -> DataFrame:
    """doc, score: the explicit formula over the distinct terms of a query."""
    hits = index.filter(F.col("term").isin(*sorted(set(terms))))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / F.lit(average)))
    return hits.join(F.broadcast(df), "term").groupBy("doc").agg(F.sum(part).alias("score"))  # a row a query term


def prefix_and(index: DataFrame, prefixes: list[str]) -> DataFrame:
    """doc, hits: documents that hold a word for each prefix (eight at most, by definition of the search)."""
    if len(prefixes) > 8:
        raise ValueError("a search takes eight prefixes at most")
    which = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]))
    rows = index.select("doc", "tf", F.explode(which).alias("i"))
    return rows.groupBy("doc").agg(F.countDistinct("i").alias("n"), F.sum("tf").alias("hits")).filter(F.col("n") == len(prefixes)).select("doc", "hits")


def snippet(text: Column, prefixes: list[str], before: int = 8, size: int = 24) -> Column:
    """The words around the first hit, hits in brackets."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)
    hit = lambda w: fold_lower(w).rlike("^[^a-z0-9]*(" + "|".join(prefixes) + ")")
    first = F.array_position(F.transform(words, hit), F.lit(True)).cast("int")
    cut = F.slice(words, F.greatest(first - before, F.lit(1)), F.lit(size))
    return F.when(first > 0, F.array_join(F.transform(cut, lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantised(a: Column) -> Column:
    """Symmetric 8-bit integers, halves up. The scale is bound once a row."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    each = lambda t: F.transform(a, lambda x: F.when(t > 0, F.floor(x.cast("double") * 127 / t + 0.5)).otherwise(0).cast("int"))
    return F.transform(F.array(top), each)[0]


def dequantised(a: Column, top: Column) -> Column:
    """Doubles again, for the greatest absolute value that was."""
    return F.transform(a, lambda x: x * top / 127)


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The nearest rows by cosine, exactly, after any filter; ties by id."""
    rows = vectors if where is None else vectors.filter(where)
    q, length = F.array(*[F.lit(float(x)) for x in query]), math.sqrt(sum(float(x) ** 2 for x in query))
    n = norm(F.col(vector)) * F.lit(length)  # the query's norm is known here
    return rows.select(key, F.when(n > 0, dot(F.col(vector), q) / n).otherwise(F.lit(0.0)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(*branches: DataFrame) -> DataFrame:
    """doc, score of ranked branches (doc, rank); a document counts once in a branch."""
    rows = None
    for b in branches:
        part = b.groupBy("doc").agg((1 / (RRF + F.min("rank"))).alias("part"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("doc").agg(F.sum("part").alias("score"))


def context_budget(ranked: DataFrame, score: str, text: str, rank: str, least: float, chars: int) -> DataFrame:
    """Rows in rank order until the first that overflows the budget; the first row always stays, cut to the budget. Texts come out masked."""
    good = ranked.filter(F.col(score) >= least)
    w = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)  # of one query's few candidates
    rows = good.withColumn("_upto", F.sum(F.length(text)).over(w)).withColumn("_at", F.row_number().over(Window.orderBy(rank)))
    kept = rows.filter((F.col("_upto") <= chars) | (F.col("_at") == 1)).drop("_upto", "_at")
    return kept.withColumn(text, F.substring(mask(F.col(text)), 1, chars))


def greedy_clusters(rows: DataFrame, group: str, key: str, vector: str, weight: str, least: float) -> DataFrame:
    """Within each group, by weight: a row joins the nearest centre or becomes one. Depends on order, so a group is scanned."""

    def scan() -> Callable[[tuple | None], list[tuple]]:
        # what is held for a group are its centres
        names: list = []
        centres = np.zeros((0, 0))

        def step(row: tuple | None) -> list[tuple]:
            nonlocal centres
            if row is None:
                return []
            of, name, x, _ = row
            x = np.asarray(x, float)
            x /= max(np.linalg.norm(x), 1e-12)
            near = centres[: len(names)] @ x if names else np.zeros(0)
            best = int(near.argmax()) if len(near) else -1
            if best >= 0 and near[best] >= least:
                return [(of, name, names[best])]
            if len(names) == len(centres):
                centres = np.concatenate([centres.reshape(-1, len(x)), np.zeros((max(16, len(names)), len(x)))])
            centres[len(names)] = x
            names.append(name)
            return [(of, name, name)]

        return step

    kinds = dict(rows.dtypes)
    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, centre {kinds[key]}"
    return scan_sorted(rows.select(group, key, vector, weight), [group], [F.desc(weight), key], schema, scan)


def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall at ``k`` and mean reciprocal rank over queries with anything relevant; results: query, doc, rank."""
    hit = relevant.join(results, ["query", "doc"], "left")
    per = hit.groupBy("query").agg(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def ranked_prefix_search(index: DataFrame, docs: DataFrame, key: str, prefixes: list[str], n_docs: int, average: float, where: Column, k: int) -> DataFrame:
    """key, score, n_all: the ``k`` best documents that hold a word for each prefix and pass the filter, and how many do in all.

    Only rows of words that a prefix begins leave the index's tasks.
    """
    if len(prefixes) > 8:
        raise ValueError("a search takes eight prefixes at most")
    which = F.array_compact(F.array(*[F.when(F.col("term").startswith(p), F.lit(i)) for i, p in enumerate(prefixes)]))
    rows = index.withColumn("i", which).filter(F.size("i") > 0)
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_length") / F.lit(average)))
    scored = rows.join(df, "term").groupBy("doc").agg(F.sum(part).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_set("i")))).alias("n"))
    good = scored.filter(F.col("n") == len(prefixes)).join(docs.filter(where).select(F.col(key).alias("doc")), "doc", "left_semi")
    total = good.agg(F.count("*").alias("n_all"))
    return good.select(F.col("doc").alias(key), F.round("score", 6).alias("score")).orderBy(F.desc("score"), key).limit(k).join(F.broadcast(total), F.lit(True))  # one row


def any_terms(docs: DataFrame, key: str, text: Column, terms: list[str], phrases: list[list[str]]) -> DataFrame:
    """key, n_terms, has_phrase of documents with any of the terms; identifiers are phrases whose words stand side by side."""
    words = F.filter(F.split(fold_lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    joined = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    phrase = F.lit(False)
    for p in phrases:
        phrase = phrase | joined.contains(" " + " ".join(p) + " ")
    rows = docs.select(key, words.alias("w")).select(key, F.size(F.array_intersect("w", F.array(*map(F.lit, terms)))).alias("n_terms"), phrase.alias("has_phrase"))
    return rows.filter("n_terms > 0 OR has_phrase")


def promoted(rows: DataFrame, key: str, cites: Column, matched: Column, rank: str) -> DataFrame:
    """New places: rows that cite the identifier first, by matched terms, and else in the order they had. For the few candidates of one query."""
    w = Window.orderBy(F.desc(cites.cast("int")), F.desc(F.when(cites, matched).otherwise(0)), rank)
    return rows.select(key, F.row_number().over(w).alias("place"))
