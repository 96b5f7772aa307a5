"""Quality rules with thresholds that adapt to each language and source.

No rule holds a fixed cutoff. Each metric of each (language, source) group is
summarised by a mergeable quantile sketch: counts of values rounded down to
seven significant bits, so a quantile is off by less than 1/64 of its value and
two sketches merge by adding counts. Rates count one event more than seen, over
one place more, so that a short text's rate spreads as widely as it is uncertain.
A group's sketch is joined by ``PRIOR`` documents' weight of its language's
sketch, a language's by as much of that of all documents: small groups lean on
their parents, large ones stand for themselves, and nothing switches at a size.
The fences are ``SPREADS`` quartile distances beyond the quartiles (a distance
is at least the sketch's resolution); a join on language and source then filters
the documents.

Cases: a null or empty text has no words and fails the base rule. Null
languages and sources are groups of their own. Repeated rows count and are
judged as often as they occur. Other columns are ignored, or carried along on
request. Texts of any length are read whole. A document at a fence stays, so ties
at it do not matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick, stored

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
PRIOR = 100
SPREADS = 8
#: Integer parts that a sketch's weights are counted in.
UNIT = 1_000_000
#: metric: (integer expression over the features, in hundred-thousandths, whether low values are outliers too)
METRICS = {
    "symbol_rate": ("(n_symbols + 1) * 100000 div (n_words + 1)", False),
    "dup_line_rate": ("(n_dup_lines + 1) * 100000 div (n_lines + 1)", False),
    "repeat_rate": ("(n_repeat_words + 8) * 100000 div (n_words + 8)", False),
    "stutter_rate": ("(n_stutter + 1) * 100000 div (n_words + 1)", False),
    "upper_rate": ("(n_upper + 1) * 100000 div (word_chars + 1)", False),
    "word_length": ("word_chars * 100000 div n_words", True),
}
_SPACE = r"[\\x20\\x09-\\x0D]+"
_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_upper")

#: Words of 8-word windows that occur again in the text, from the hashes ``h`` of its words.
_REPEATS = """
CASE WHEN size(h) < 8 THEN 0L ELSE
get(transform(array(zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (a, b) -> xxhash64(a, b))), h2 ->
get(transform(array(zip_with(slice(h2, 1, size(h2) - 2), slice(h2, 3, size(h2) - 2), (a, b) -> xxhash64(a, b))), h4 ->
get(transform(array(zip_with(slice(h4, 1, size(h4) - 4), slice(h4, 5, size(h4) - 4), (a, b) -> xxhash64(a, b))), h8 ->
  CASE WHEN size(array_distinct(h8)) = size(h8) THEN 0L ELSE
  get(transform(array(array_sort(transform(h8, (x, i) -> struct(x, i)))), s ->
  get(transform(array(array_sort(transform(
      filter(s, (e, k) -> e.x <=> get(s, k - 1).x OR e.x <=> get(s, k + 1).x), e -> e.i))), p ->
    aggregate(p, struct(0L AS n, -8 AS last), (acc, v) -> struct(acc.n + least(8, v - acc.last) AS n, v AS last), acc -> acc.n)), 0)), 0)
  END), 0)), 0)), 0) END
"""


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """One row a document: doc_id, lang, source, the counts of ``_FEATURES`` and the columns to carry."""
    names = [n for n in dict.fromkeys(("doc_id", "text", "lang", "source", *carry))]
    rows = pick(docs, *names).withColumn("t", F.coalesce("text", F.lit("")))
    gone = lambda keep: f"length(regexp_replace(t, '{keep}', ''))"
    exprs = {
        "w": f"filter(split(t, '{_SPACE}'), x -> x <> '')",
        "n_lines_dups": r"get(transform(array(filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), x -> struct(CAST(size(x) AS BIGINT) AS n, CAST(size(x) - size(array_distinct(x)) AS BIGINT) AS dups)), 0)",
        "word_chars": "CAST(" + gone(_SPACE) + " AS BIGINT)",
        "n_symbols": "CAST(" + gone("[^#*$%&|<>]+") + " AS BIGINT)",
        "n_upper": "CAST(" + gone("[^A-ZÀ-ÖØ-Þ]+") + " AS BIGINT)",
    }
    rows = rows.select(*names, *[F.expr(e).alias(n) for n, e in exprs.items() if n != "w"], *[
        F.expr(f"get(transform(array({exprs['w']}), w -> struct(CAST(size(w) AS BIGINT) AS n_words,"
               " CAST(size(filter(w, (x, i) -> i > 0 AND x = get(w, i - 1))) AS BIGINT) AS n_stutter,"
               f" get(transform(array(transform(w, x -> xxhash64(x))), h -> {_REPEATS}), 0) AS n_repeat_words)), 0)").alias("ww")
    ])
    rows = rows.withColumns({"n_lines": F.col("n_lines_dups.n"), "n_dup_lines": F.col("n_lines_dups.dups")})
    rows = rows.withColumns({n: F.col(f"ww.{n}") for n in ("n_words", "n_stutter", "n_repeat_words")})
    return rows.select(*dict.fromkeys(("doc_id", "lang", "source", *carry)), *_FEATURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _metrics(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: F.when(F.col("n_words") > 0, F.expr(e)) for m, (e, _) in METRICS.items()})


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the quantile sketch of each group of documents that pass the base rule."""
    long = ", ".join(f"'{m}', {m}" for m in METRICS)
    cells = _metrics(rows.filter(~base_failed())).selectExpr("lang", "source", f"stack({len(METRICS)}, {long}) AS (metric, value)")
    shift = "greatest(length(bin(value)) - 7, 0)"
    return cells.withColumn("bucket", F.expr(f"shiftleft(shiftright(value, {shift}), {shift})")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def _limits(sketch: str, div: str) -> str:
    """SQL for lang, source and the fences of each metric, out of the groups' sketches (lang, source, metric, bucket, n)."""
    spread = f"greatest(q75 - q25, q75 {div} 64 + 1)"
    fences = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN q75 + {SPREADS} * {spread} END) AS {m}_high"
        + (f", max(CASE WHEN metric = '{m}' THEN q25 - {SPREADS} * {spread} END) AS {m}_low" if low else "")
        for m, (_, low) in METRICS.items()
    )
    # a parent's sketch as parts of UNIT; its children take PRIOR of them
    return f"""
      every_n AS (SELECT metric, bucket, sum(n) AS n FROM {sketch} GROUP BY metric, bucket),
      every AS (SELECT metric, bucket, n * {UNIT} {div} sum(n) OVER (PARTITION BY metric) AS share FROM every_n),
      lang_parts AS (
        SELECT lang, metric, bucket, n * {UNIT} AS w FROM {sketch} UNION ALL
        SELECT g.lang, e.metric, e.bucket, {PRIOR} * e.share FROM (SELECT DISTINCT lang, metric FROM {sketch}) g JOIN every e ON g.metric = e.metric),
      lang_n AS (SELECT lang, metric, bucket, CAST(sum(w) AS BIGINT) AS w FROM lang_parts GROUP BY lang, metric, bucket),
      langs AS (SELECT lang, metric, bucket, w {div} greatest(CAST(sum(w) OVER (PARTITION BY lang, metric) AS BIGINT) {div} {UNIT}, 1) AS share FROM lang_n),
      group_parts AS (
        SELECT lang, source, metric, bucket, n * {UNIT} AS w FROM {sketch} UNION ALL
        SELECT g.lang, g.source, l.metric, l.bucket, {PRIOR} * l.share
        FROM (SELECT DISTINCT lang, source, metric FROM {sketch}) g JOIN langs l ON g.metric = l.metric AND g.lang IS NOT DISTINCT FROM l.lang),
      group_n AS (SELECT lang, source, metric, bucket, sum(w) AS w FROM group_parts GROUP BY lang, source, metric, bucket),
      ranked AS (
        SELECT *, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, metric) AS total FROM group_n),
      quartiles AS (
        SELECT lang, source, metric, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q25, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q75
        FROM ranked GROUP BY lang, source, metric),
      limits AS (SELECT lang, source, {fences} FROM quartiles GROUP BY lang, source)"""


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and low and high fences of each metric."""
    return sketch.sparkSession.sql(f"WITH sketch AS (SELECT * FROM {{sketch}}), {_limits('sketch', 'div')} SELECT * FROM limits", sketch=sketch)


def judge(rows: DataFrame) -> DataFrame:
    """Add base_failed and kept to stored features. A group without any document that passes the base rule keeps none."""
    limits = thresholds(sketches(rows)).withColumnsRenamed({"lang": "group_lang", "source": "group_source"})
    joined = _metrics(rows).join(limits, F.col("lang").eqNullSafe(F.col("group_lang")) & F.col("source").eqNullSafe(F.col("group_source")), "left")
    good = ~base_failed()
    for m, (_, low) in METRICS.items():
        good &= F.col(m) <= F.col(f"{m}_high")
        if low:
            good &= F.col(m) >= F.col(f"{m}_low")
    return joined.withColumns({"base_failed": base_failed(), "kept": F.coalesce(good, F.lit(False))}).select(*rows.columns, "base_failed", "kept")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each document."""
    return judge(stored(features(docs), "quality-features")).select("doc_id", *_FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``documents``."""
    rows = stored(features(docs, "text", "n_chars"), "quality-features")
    return judge(rows).filter("kept").select("doc_id", "text", "lang", "source", "n_chars")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def _oracle(docs: str = "documents") -> str:
    space = r"[\x20\x09-\x0D]+"
    metrics = ", ".join(f"CASE WHEN n_words > 0 THEN {e.replace(' div ', ' // ')} END AS {m}" for m, (e, _) in METRICS.items())
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS value FROM measured WHERE NOT base_failed" for m in METRICS)
    good = " AND ".join([f"{m} <= {m}_high" for m in METRICS] + [f"{m} >= {m}_low" for m, x in METRICS.items() if x[1]])
    return rf"""
WITH src AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, lang, source FROM {docs}),
cut AS (SELECT *, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM src),
words AS (SELECT row_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM cut),
grams AS (SELECT row_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o,
  lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS gram, lead(word, 7) OVER o AS last_word,
  lag(word) OVER o = word AS stutter FROM words WINDOW o AS (PARTITION BY row_id ORDER BY i)),
again AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS c FROM grams WHERE last_word IS NOT NULL) WHERE c > 1),
repeats AS (SELECT row_id, sum(least(8, i - coalesce(before, -8))) AS n FROM
  (SELECT row_id, i, lag(i) OVER (PARTITION BY row_id ORDER BY i) AS before FROM again) GROUP BY row_id),
stutters AS (SELECT row_id, count(*) AS n FROM grams WHERE stutter GROUP BY row_id),
counted AS (SELECT row_id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_stutter,
  CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_upper
  FROM cut LEFT JOIN repeats r USING (row_id) LEFT JOIN stutters s USING (row_id)),
measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {metrics} FROM counted),
cells AS ({cells}),
bucketed AS (SELECT lang, source, metric, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS bucket FROM cells),
sketch AS (SELECT lang, source, metric, bucket, count(*) AS n FROM bucketed GROUP BY ALL),
{_limits("sketch", "//")}
SELECT m.doc_id, {", ".join(f"m.{f}" for f in _FEATURES)}, m.base_failed, coalesce(NOT m.base_failed AND {good}, false) AS kept
FROM measured m LEFT JOIN limits t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


ORACLE = _oracle()
