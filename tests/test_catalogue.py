"""Every query against its SQL, or against a brute-force version where SQL has none."""

import datetime
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from civiledger.plans import catalogue
from civiledger.functions import keys, text
from civiledger.operators import extract
from comparing import SF, duck_rows, rows_of
from pyspark.sql import functions as F



@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    names, want = duck_rows(duck, catalogue.ORACLES[name])
    assert sorted(got.columns) == names
    assert rows_of(got) == want


def test_approximate_counts_are_close(spark, duck):
    exact = dict(duck.execute("SELECT CAST(year(o_orderdate) AS INT), count(DISTINCT o_custkey) FROM orders GROUP BY 1").fetchall())
    for r in catalogue.QUERIES["approx_distinct_payees"](spark, SF).collect():
        assert abs(r["n_payees"] - exact[r["fiscal_year"]]) <= 0.1 * exact[r["fiscal_year"]] + 1


def test_greedy_windows_against_a_plain_scan(spark, duck):
    got = {(r["payee_id"], r["window_start"], r["window_end"], r["n_dates"], r["total"]) for r in catalogue.QUERIES["greedy_forward_windows"](spark, SF).collect()}
    days = defaultdict(dict)
    for payee, day, value in duck.execute("SELECT o_custkey, CAST(o_orderdate AS DATE), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders GROUP BY ALL").fetchall():
        days[payee][day] = value
    want = set()
    for payee, of in days.items():
        order, i = sorted(of), 0
        while i < len(order):
            inside = [d for d in order[i:] if d <= order[i] + datetime.timedelta(days=90)]
            total = round(sum(of[d] for d in inside), 2)
            if len(inside) >= 3 and total >= 300_000:
                want.add((payee, str(order[i]), str(inside[-1]), len(inside), total))
                i += len(inside)
            else:
                i += 1
    assert got == want


def test_greedy_clusters_against_a_plain_scan(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("label", "vec_id").collect()
    want, centres = {}, defaultdict(list)
    for r in rows:
        x = np.array(r["embedding"], float)
        x /= np.linalg.norm(x)
        near = [(float(c @ x), -k, name) for k, (name, c) in enumerate(centres[r["label"]])]
        best = max(near, default=(-2, 0, None))
        want[r["vec_id"]] = best[2] if best[0] >= 0.6 else r["vec_id"]
        if best[0] < 0.6:
            centres[r["label"]].append((r["vec_id"], x))
    assert {r["vec_id"]: r["centre"] for r in catalogue.QUERIES["greedy_embedding_clusters"](spark, SF).collect()} == want


def test_anchored_buckets_hold_every_event_once(spark):
    got = catalogue.QUERIES["anchored_time_buckets"](spark, SF).collect()
    assert sum(r["n"] for r in got) == spark.read.parquet(f"{SF}/events.parquet").count()
    by = defaultdict(list)
    for r in got:
        by[r["user_id"]].append(r["bucket_start"])
    assert all((b - a).total_seconds() >= 6 * 3600 for x in by.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))


def test_jaccard_clusters_against_a_plain_scan(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", text.tokens(F.col("text")).alias("tokens")).orderBy("source", "doc_id").collect()
    want, centres = {}, defaultdict(list)
    for r in rows:
        x = set(r["tokens"])
        best = next((i for i, y in centres[r["source"]] if len(x & y) >= 0.75 * len(x | y) and x & y), None)
        want[r["doc_id"]] = r["doc_id"] if best is None else best
        if best is None:
            centres[r["source"]].append((r["doc_id"], x))
    got = {r["doc_id"]: r["centre"] for r in catalogue.QUERIES["greedy_jaccard_clusters"](spark, SF).collect()}
    assert got == want and len(set(want.values())) < len(want)
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert {r["centre"]: r["n_documents"] for r in catalogue.QUERIES["recurring_objects"](spark, SF).collect()} == {c: n for c, n in sizes.items() if n > 1}


def test_samples_are_of_every_group_and_stay(spark, duck):
    draw = lambda: sorted((r["fiscal_year"], r["kind"], r["entry_id"]) for r in catalogue.QUERIES["sampled_rows"](spark, SF).collect())
    got = draw()
    sizes = dict(((y, k), n) for y, k, n in duck.execute("SELECT CAST(year(o_orderdate) AS INT), o_orderstatus, count(*) FROM orders GROUP BY ALL").fetchall())
    count = defaultdict(int)
    for y, k, _ in got:
        count[y, k] += 1
    assert count == {g: min(n, 5) for g, n in sizes.items()} and got == draw()


def test_anchored_buckets_against_a_plain_scan(spark):
    got = {(r["user_id"], r["bucket_start"]): (r["n"], r["joined"]) for r in catalogue.QUERIES["anchored_time_buckets"](spark, SF).collect()}
    want, last = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r["user_id"], r["ts"], r["event_type"])):
        at = last.get(r["user_id"])
        if at is None or (r["ts"] - at).total_seconds() >= 6 * 3600:
            at = last[r["user_id"]] = r["ts"]
            want[r["user_id"], at] = (0, "")
        n, said = want[r["user_id"], at]
        want[r["user_id"], at] = (n + 1, f"{said} {r['event_type']}".strip())
    assert got == want


def test_quoted_lines_and_blocks_without_an_end(spark):
    lines = [(1, i, x) for i, x in enumerate(["noise", 'REGISTRATION;7', 'PERIOD;13/2021', '1;Pay;1.000,50;0,00', 'TOTALS;"Gross: 1.000,50', "", 'Net: 9,99"', "REGISTRATION;8", 'DEPARTMENT;"a', "REGISTRATION;9", 'b"', "1;x;1,00;0,00"])]
    rows = spark.createDataFrame(lines, "file int, number int, line string")
    logical = {r["number"]: r["line"] for r in extract.logical_lines(rows, "file", "number", "line").collect()}
    assert logical[5] == 'TOTALS;"Gross: 1.000,50\n\nNet: 9,99"' and logical[7] == 'DEPARTMENT;"a\nREGISTRATION;9\nb"' and len(logical) == 8
    (r,) = extract.payroll_blocks(rows, "file", "number", "line").collect()
    assert (r["registration"], r["month"], r["year"], r["gross"], r["net"], r["n_rubrics"], r["earnings"]) == ("7", 13, 2021, 1000.5, 9.99, 1, 1000.5)


def test_searches_of_too_many_terms_are_refused(spark):
    with pytest.raises(ValueError):
        keys.search_terms("a b c d e f g h i")
    assert keys.search_terms('Ação AND "foo*"') == ["acao", "foo"] and keys.escape_like("5%_") == "5\\%\\_"
    assert keys.period_years(2020, 2021) == [2020] and keys.period_years(None, 2021) == [2021, 2022, 2023, 2024] and keys.period_years(None, None) is None


def test_attendance_covers_everybody(spark, duck):
    got = catalogue.QUERIES["range_containment_attendance_all"](spark, SF).select("event_type", "user_id").collect()
    want = duck.execute("SELECT DISTINCT event_type, user_id FROM events WHERE event_type IN ('error', 'signup')").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scored_match_of_any_length(spark, duck, tmp_path):
    docs = duck.execute("(SELECT doc_id, text FROM documents WHERE length(text) < 1000 ORDER BY doc_id LIMIT 60) UNION ALL (SELECT doc_id, text FROM documents WHERE length(text) >= 1000 ORDER BY doc_id LIMIT 60)").fetchall()
    items = duck.execute("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 50").fetchall()
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["item_id"], r["score"]) for r in catalogue.QUERIES["scored_fuzzy_match_all"](spark, str(tmp_path)).collect()}

    def words(text):
        plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return {w for w in re.split("[^a-z0-9]+", plain.lower()) if len(w) >= 5}

    sets, want = {i: words(t) for i, t in items}, {}
    for d, t in docs:
        x = words(t)
        scores = [(-int(100 * len(x & y) / min(len(x), len(y)) + 0.5), i) for i, y in sets.items() if x and y]
        if scores and -min(scores)[0] >= 40:
            want[d] = (min(scores)[1], -min(scores)[0])
    assert got == want and any(len(t) >= 1000 and d in got for d, t in docs)


def test_snippets_mark_a_hit(spark):
    got = catalogue.QUERIES["snippets"](spark, SF).collect()
    assert got and all("[" in r["snippet"] for r in got)


def test_hybrid_stays_within_its_budget(spark):
    got = catalogue.QUERIES["hybrid_retrieve"](spark, SF)
    texts = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "doc")
    lengths = [len(r["text"]) for r in got.join(texts, "doc").orderBy("rank").collect()]
    assert lengths and (len(lengths) == 1 or sum(lengths) <= 12_000)


def test_snippets_against_a_plain_cut(spark):
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).lower()
    hit = lambda w: re.match("[^a-z0-9]*(the|ing|eres)", fold(w))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", r["text"]) if w]
        first = next((k for k, w in enumerate(words) if hit(w)), None)
        if first is not None:
            cut = words[max(first - 8, 0) :][:24]
            want[r["doc_id"]] = " ".join(f"[{w}]" if hit(w) else w for w in cut)
    assert {r["doc_id"]: r["snippet"] for r in catalogue.QUERIES["snippets"](spark, SF).collect()} == want


def test_hybrid_takes_the_best_that_fit(spark):
    fused = sorted(((-r["score"], r["doc"]) for r in catalogue.QUERIES["rrf_fusion"](spark, SF).collect()))[:20]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # ranks are of the first twenty; those that are no documents leave a gap
    want, used = [], 0
    for rank, (score, doc) in enumerate(fused, 1):
        if doc in texts:
            if want and used + len(texts[doc]) > 12_000:
                break
            want.append((doc, rank, -score))
            used += len(texts[doc])
    assert [(r["doc"], r["rank"], r["score"]) for r in catalogue.QUERIES["hybrid_retrieve"](spark, SF).orderBy("rank").collect()] == want


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
