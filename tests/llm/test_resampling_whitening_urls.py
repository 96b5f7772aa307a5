"""Importance resampling, whitening and the URL filter: SQL, brute force and awkward inputs."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from awkward_rows import awkward_rows, prose
from civiledger.llm import resampling, url_filter, whitening
from comparing import SF, duck_rows, rows_of

ROWS = awkward_rows()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# importance resampling


def test_resampling_matches_sql(spark, duck):
    got = resampling.op11_importance_resampling(spark, SF)
    names, want = duck_rows(duck, resampling.ORACLE)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_hashed_ngrams_against_spelled_ones():
    r = random.Random(1)
    texts = [None, "", "!?", *[" ".join(r.choice(["a", "B", "é", "x1", "..", "漢", "q" * 300]) for _ in range(r.randint(0, 9))) for _ in range(300)]]
    sizes, grams = resampling.hashed(texts, 3, 97)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    for n, (owner, found) in enumerate(grams, 1):
        want = [(i, zlib.crc32(" ".join(w[k : k + n]).encode()) % 97) for i, t in enumerate(texts) for w in [words(t)] for k in range(len(w) - n + 1)]
        assert list(zip(owner.tolist(), found.tolist(), strict=True)) == want


def test_blocks_do_not_change_results(spark, awkward, monkeypatch):
    want = rows_of(resampling.weighed(awkward, np.arange(10_000)))
    monkeypatch.setattr(resampling, "BLOCK_BYTES", 40)
    assert rows_of(resampling.weighed(awkward, np.arange(10_000))) == want


def test_resampling_on_awkward_rows(spark, awkward, nothing):
    target = awkward.filter("lang = 'de'")
    got = resampling.resample(awkward, target, percent=50).collect()
    assert len(got) == len(ROWS)
    able = [r for r in got if r["n_words"] >= 20]
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(able) // 2 + 1)) and all(r["n_words"] >= 20 for r in got if r["rank"])
    order = sorted(able, key=lambda r: (-r["score"], -1 if r["doc_id"] is None else r["doc_id"]))
    assert [(r["doc_id"], r["score"]) for r in order[: len(ranks)]] == [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    for r in got:
        if r["doc_id"]:
            w = next(len(words(t)) for i, t, *_ in ROWS if i == r["doc_id"])
            assert (r["n_words"], r["n_features"]) == (w, w + max(w - 1, 0))
    assert resampling.resample(nothing, nothing).count() == 0
    assert {r["weight"] for r in resampling.resample(awkward, nothing).collect() if r["n_words"] == 0} == {0}
    assert resampling.drawn(awkward, target).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_ranks_of_a_hot_id(spark):
    """A third of the rows have one id and score; ranks stay dense, and ties go to smaller ids."""
    rows = [(7 if i % 3 == 0 else 1000 + i, (i * 37) % 11 if i % 3 else 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, score bigint").repartition(5)
    from civiledger.llm.common import stored
    from pyspark.sql import functions as F

    got = resampling.ranked(stored(docs, "scores"), F.lit(True), 2000).collect()
    want = {}
    for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        want.setdefault(r, []).append(k if k <= 2000 else None)
    have = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"], r["score"]].append(r["rank"])
    assert {k: sorted(v, key=lambda x: x or 1e9) for k, v in have.items()} == want


def test_draw_leans_towards_the_target(spark):
    r = random.Random(5)
    side = lambda k: " ".join(r.choice(("alpha beta gamma delta" if k else "one two three four").split()) for _ in range(40))
    docs = spark.createDataFrame([(i, side(i % 4 == 0)) for i in range(400)], "doc_id bigint, text string")
    target = spark.createDataFrame([(i, side(True)) for i in range(20)], "item_id bigint, text string")
    drawn = [x["doc_id"] for x in resampling.resample(docs, target).filter("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) >= 70


# whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    c = (n * x - total) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * x - total).astype(object) ** 2).sum(1), c @ u / np.sqrt(e), e / e.sum()


def check_whitening(got, ids, vectors, most):
    deviation, white, explained = plain_whitening(vectors)
    at, signs = {i: k for k, i in enumerate(ids)}, {}
    assert len(got) == len(ids) * most
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        k, j = at[r["vec_id"]], r["component"] - 1
        sign = signs.setdefault(j, 1 if white[k, j] * r["whitened"] > 0 else -1)
        assert r["n"] == len(ids) and int(r["deviation"]) == deviation[k] and abs(r["explained"] - explained[j]) < 1e-9
        assert abs(white[k, j] - sign * r["whitened"]) < 1e-8 and r["identity_error"] < 1e-9


def test_whitening_against_numpy(spark, duck):
    rows = [(i, v) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if v and all(c is not None and math.isfinite(c) for c in v)]
    got = whitening.op12_embedding_whitening(spark, SF).collect()
    check_whitening(got, [i for i, _ in rows], [v for _, v in rows], 32)
    assert spark.createDataFrame(got).schema["vec_id"].dataType.simpleString() == "bigint"


AWKWARD_VECTORS = "vec_id bigint, embedding array<float>, x string, whitened string, sums string"


def test_whitening_on_awkward_rows(spark):
    r = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in r.normal(size=5) * [1, 2, 3, 4, 5]]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [-float("inf"), 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*x, "a", "b", "c") for x in good + bad], AWKWARD_VECTORS).repartition(3)
    check_whitening(whitening.components(frame, 3).collect(), [i for i, _ in good], [v for _, v in good], 3)
    assert whitening.components(frame.limit(0)).count() == 0 and whitening.components(frame.filter("vec_id > 99 AND vec_id <> 105")).count() == 0


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = whitening.components(one.union(one)).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), float(2 * i), 1.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
    got = whitening.components(line).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1} and all(r["identity_error"] < 1e-9 for r in got)


def test_large_deviations_are_exact(spark):
    rows = [(0, [3e9, -1.0]), (1, [-3e9, 5.0]), (2, [7.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = plain_whitening([v for _, v in rows])[0]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.components(frame).collect()}
    assert got == dict(enumerate(want.tolist())) and max(got.values()) > 2**63


# URL filter

URLS = [
    None, "", "no scheme", "http://", "http://net", "https://A.Example.NET/en/x?q#f", "http://example.net/en", "http://xexample.net/en/a", "http://notnet/", "ftp://net/",
    "http://user@b.example.com:80/de/1", "http://b.example.com/de/1?x=/y", "http://fr.org/fr/", "http://example.org?x/fr/", "http://example.org#a://net/", "x://y.org/fr/\n://", "http://漢字.org/é/ü", "HTTP://" + "a" * 5000 + ".net/" + "b" * 5000,
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = host.translate(LOWER), None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, None))


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, score string, half string")


def many_urls(seed, n):
    r = random.Random(seed)
    host = lambda: r.choice(["", "www.", "m."]) + r.choice(["ab", "cd", "ef"]) + ".example." + r.choice(["com", "net", "org"])
    return [f"http://{host()}/{r.choice(['en', 'de', 'fr'])}/{r.randint(1, 500)}" for _ in range(n)]


def test_urls_and_rules(spark):
    got = url_filter.judge(pages_of(spark, URLS + many_urls(1, 200))).collect()
    for r, url in zip(sorted(got, key=lambda r: r["page_id"]), URLS + many_urls(1, 200), strict=True):
        host, path, rule, verdict = plain_parts(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_share"] >= 0.5 else "allow"))


def plain_score(url, counts):
    """Log-likelihood a sign of one model, context by context."""
    known = [c for c in map(chr, range(32, 127)) if not c.isupper()]
    signs = [known.index(c.lower()) if c.isascii() and c.lower() in known else 69 for c in url] + [71]
    padded, total = [70] * url_filter.ORDER + signs, 0.0
    for i in range(len(signs)):
        p, at, context = 1 / 72, 0, 0
        for k in range(url_filter.ORDER + 1):
            if k:
                context = (context * 72 + padded[i + url_filter.ORDER - k]) % 2**64
            bucket = context if k <= 2 else (context * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 13)
            row = counts[(at + bucket) * 72 : (at + bucket + 1) * 72]
            p = (row[signs[i]] + 4 * p) / (row.sum() + 4)
            at += 72**k if k <= 2 else url_filter.LONG
        total += math.log(p)
    return total / len(signs)


def test_models_against_plain_counts(spark):
    urls = many_urls(2, 120)
    parts = [plain_parts(u) for u in urls]
    texts = [[h + p for h, p, _, v in parts if v == s] for s in ("allow", "block")]
    counts = np.zeros((2, url_filter.CELLS))
    for k in (0, 1):
        for u in texts[k]:
            for row in url_filter.cells([u])[1]:
                np.add.at(counts[k], row, 1)
    ratio = url_filter.Ratio(counts)
    probe = ["", "m.ab.example.com/en/1", "漢x", *[h + p for h, p, *_ in parts[:5]]]
    want = [plain_score(u, counts[0]) - plain_score(u, counts[1]) for u in probe]
    assert np.allclose(ratio.score(probe), want, atol=1e-12)
    # every context's shares add up to one
    full = counts[0].reshape(-1, 72)
    assert full.sum(1).min() >= 0 and full[0].sum() == sum(len(u) + 1 for u in texts[0])
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages_of(spark, urls)).collect()}
    assert np.allclose([got[i] for i in range(len(urls))], ratio.score([h + p for h, p, *_ in parts]), atol=1e-12)


def test_held_out_urls_and_order_of_rows(spark):
    """Rule-decided URLs that the models have not seen are told apart, and partitions do not matter."""
    rules = (("bad", "/", "block"), ("good", "/", "allow"))
    r = random.Random(9)
    urls = [f"http://{'spam' if k else 'news'}-{r.randint(0, 10**6)}.{'bad' if k else 'good'}/{'buy' if k else 'read'}/{r.randint(0, 999)}" for k in (0, 1) for _ in range(300)]
    open_ = [f"http://{'spam' if k else 'news'}-{r.randint(0, 10**6)}.other/{'buy' if k else 'read'}/{r.randint(0, 999)}" for k in (0, 1) for _ in range(100)]
    pages = pages_of(spark, urls + open_)
    got = {x["page_id"]: x for x in url_filter.judge(pages, rules=rules).collect()}
    right = sum((got[600 + i]["verdict"] == "block") == (i >= 100) for i in range(200))
    assert right >= 196
    again = {x["page_id"]: x for x in url_filter.judge(pages.repartition(7), rules=rules).collect()}
    assert all(got[i]["verdict"] == again[i]["verdict"] for i in got)
    assert url_filter.allowed(pages, rules).columns == ["page_id", "url", "html"]


@pytest.mark.parametrize("urls", [[], [None, "x"], ["http://a.net/", "http://a.org/en/"], ["http://a.org/fr/"]])
def test_without_both_verdicts(spark, urls):
    got = url_filter.judge(pages_of(spark, urls)).collect()
    assert len(got) == len(urls) and all(r["score"] is None and (r["verdict"] == "allow") == (r["rule"] in (None, "org/fr/")) for r in got)
