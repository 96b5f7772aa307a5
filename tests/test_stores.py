"""Versioned tables, resumable loads, the kept search index and the vector store."""

import math

import pytest
from civiledger.operators import text_index, vector_store
from civiledger.sources.versions import BucketedTable, Conflict, Manifests
from civiledger.streaming import jobs, resume
from pyspark.sql import functions as F

SCHEMA = "id bigint, v bigint"


def kept(spark, path, buckets=4):
    return BucketedTable(spark, f"file://{path}", SCHEMA, ["id"], buckets)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def values(table, **how):
    return sorted((r["id"], r["v"]) for r in table.read(**how).collect())


def test_versions_switch_at_once_and_old_ones_go(spark, tmp_path):
    t = kept(spark, tmp_path)
    assert values(t) == [] and t.files.current() == (0, None)
    t.replace(rows(spark, [(i, 0) for i in range(20)]))
    before = t.files.numbers()[-1]
    touched = t.merge(rows(spark, [(3, 7)]).cache(), lambda old, new: jobs.upserted(old, new, ["id"], F.desc("v")))
    assert len(touched) == 1 and values(t) == sorted([(i, 7 if i == 3 else 0) for i in range(20)])
    assert values(t, number=before) == [(i, 0) for i in range(20)]
    # the buckets that were not touched are still those of the first version
    first, last = t.files.at(before)["buckets"], t.files.current()[1]["buckets"]
    assert [b for b in first if first[b] != last[b]] == [str(touched[0])]
    gone = t.files.vacuum()
    assert gone == [first[str(touched[0])]] and values(t) == sorted([(i, 7 if i == 3 else 0) for i in range(20)]) and t.files.numbers() == [before + 1]
    assert values(t, only=touched) == [x for x in values(t) if x[0] in {r[0] for r in t.read(touched).select("id").collect()}]


def test_a_writer_that_comes_second_is_told(spark, tmp_path):
    a, b = Manifests(spark, f"file://{tmp_path}"), Manifests(spark, f"file://{tmp_path}")
    a.commit(1, {"x": 1})
    with pytest.raises(Conflict):
        b.commit(1, {"x": 2})
    assert b.current() == (1, {"x": 1})


def test_data_of_a_run_without_manifest_goes(spark, tmp_path):
    t = kept(spark, tmp_path)
    t.replace(rows(spark, [(1, 1)]))
    t._written(rows(spark, [(9, 9)]))  # a run that dies here
    assert values(t) == [(1, 1)] and len(t.files.vacuum()) == 1 and values(t) == [(1, 1)]


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("where", ["before the slice", "while it is written", "before the switch"])
def test_a_killed_load_resumes_without_repeats(spark, tmp_path, monkeypatch, where):
    t = kept(spark, tmp_path, 8)
    t.replace(rows(spark, [(i, i) for i in range(0, 40, 2)]))
    new = rows(spark, [(i, i if i % 4 == 0 else -i) for i in range(30)] + [(5, -9), (5, -1)])
    reads, calls = [], []

    def read():
        reads.append(1)
        return new

    def going_on(k):
        if where == "before the slice" and k == 2 and not calls:
            calls.append(k)
            raise Killed

    real_written, real_commit = BucketedTable._written, Manifests.commit

    def written(self, frame):
        if where == "while it is written" and len(reads) and not calls and self.note().get("load", {}).get("next") == 2:
            calls.append(1)
            raise Killed
        return real_written(self, frame)

    def commit(self, number, manifest):
        if where == "before the switch" and manifest.get("note", {}).get("load", {}).get("next") == 3 and not calls:
            calls.append(1)
            raise Killed
        return real_commit(self, number, manifest)

    monkeypatch.setattr(BucketedTable, "_written", written)
    monkeypatch.setattr(Manifests, "commit", commit)
    with pytest.raises(Killed):
        resume.resumed_load(t, "load", read, lambda r: r, 4, going_on)
    half = t.note()["load"]
    assert half["next"] == 2 and 0 < sum(half[a] for a in resume.ACTIONS) < 30
    counts = resume.resumed_load(t, "load", read, lambda r: r, 4, going_on)
    assert reads == [1] and counts == {"inserted": 15, "updated": 7, "unchanged": 8}
    want = {i: i for i in range(0, 40, 2)} | {i: i if i % 4 == 0 else -i for i in range(30)} | {5: -1}
    assert values(t) == sorted(want.items())
    assert resume.resumed_load(t, "load", read, lambda r: r, 4) == counts and values(t) == sorted(want.items())
    t.files.vacuum()
    assert values(t) == sorted(want.items())


def test_progress_that_does_not_fit_the_input_is_refused(spark, tmp_path):
    t = kept(spark, tmp_path)
    resume.resumed_load(t, "x", lambda: rows(spark, [(1, 1)]), lambda r: r, 2)
    note = t.note()["x"] | {"rows": 5}
    t.merge(rows(spark, []), jobs.upserted, {"x": note})
    with pytest.raises(resume.Diverged):
        resume.resumed_load(t, "x", lambda: rows(spark, []), lambda r: r, 2)


def test_streamed_batches_are_merged_once(spark, tmp_path):
    for i, part in enumerate([[(1, 1), (2, 1)], [(1, 5)], []]):
        rows(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    t = kept(spark, tmp_path / "out")
    for checkpoint in ("a", "a", "b"):  # the last one forgets what it has done; the table does not
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        resume.run_bucketed_upserts(stream, t, lambda: [F.desc("v")], f"{tmp_path}/{checkpoint}")
        assert values(t) == [(1, 5), (2, 1)]
    assert len(t.files.numbers()) <= 2


def docs(spark, pairs):
    return spark.createDataFrame(pairs, "id bigint, text string")


def plain_bm25(texts, terms):
    words = {i: t.lower().split() for i, t in texts.items() if t and t.split()}
    n, average, out = len(words), sum(map(len, words.values())) / max(len(words), 1), {}
    for term in set(terms):
        hits = {i: w.count(term) for i, w in words.items() if term in w}
        for i, tf in hits.items():
            out[i] = out.get(i, 0) + math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / average))
    return {i: round(s, 9) for i, s in out.items()}


def test_index_after_any_changes(spark, tmp_path):
    index = text_index.TextIndex(spark, f"file://{tmp_path}", 4)
    assert not index.ready(["red"]) and index.size() == (0, 1.0)
    state = {1: "red fox", 2: "red red dog", 3: "blue", 4: None, 5: "", 6: "r"}
    index.upsert(docs(spark, list(state.items())), "id", "text")

    def check():
        for terms in (["red"], ["blue", "red", "none"], ["r"]):
            assert {r["doc"]: round(r["score"], 9) for r in index.bm25(terms).collect()} == plain_bm25(state, terms)
        for prefixes in (["re"], ["r", "do"], ["b"]):
            want = {i: sum(any(w.startswith(p) for p in prefixes) for w in t.split()) for i, t in state.items() if t and all(any(w.startswith(p) for w in t.split()) for p in prefixes)}
            assert {r["doc"]: r["hits"] for r in index.prefix_and(prefixes).collect()} == want

    check()
    for change in ({2: "green dog", 7: "red cat cat"}, {1: "blue fox", 2: "red dog"}):
        before = index.files.current()[1]
        state |= change
        index.upsert(docs(spark, list(change.items())), "id", "text")
        assert index.files.current()[1]["segments"][:-1] == before["segments"]  # earlier segments stay as they are
        check()
    index.delete(docs(spark, [(3, ""), (99, "")]), "id")
    state.pop(3)
    check()
    assert index.size()[0] == 4
    index.compact()
    check()
    assert len(index.files.current()[1]["segments"]) == 1 and not index.files.current()[1]["tombstones"] and len(index.files.listed("data")) == 2
    assert index.ready(["none", "fox"]) and not index.ensure(docs(spark, []), "id", "text", ["fox"])
    assert index.ensure(docs(spark, [(1, "new")]), "id", "text", ["absent"]) and [r["term"] for r in index.vocabulary().collect()] == ["new"]
    with pytest.raises(ValueError):
        index.prefixed(list("abcdefghi"))


def pieces(spark, items):
    return spark.createDataFrame([(i, d, "http://a", t, v) for i, d, t, v in items], "id bigint, doc bigint, url string, text string, vector array<double>")


def test_vector_store_by_document(spark, tmp_path):
    store = vector_store.VectorStore(spark, f"file://{tmp_path}", 2, 4)
    store.replace_documents(pieces(spark, [(1, 1, "red fox", [1.0, 0.0]), (2, 1, "red dog", [0.0, 1.0]), (3, 2, "red", [1.0, 1.0])]))
    for bad in ([1.0], [float("nan"), 1.0], [0.0, 0.0], None):
        with pytest.raises(vector_store.Refused):
            store.replace_documents(pieces(spark, [(7, 1, "x", [1.0, 1.0]), (8, 1, "x", bad)]))
    assert store.count() == 3  # what was refused has changed nothing
    store.replace_documents(pieces(spark, [(1, 1, "blue fox", [-1.0, 0.0])]))
    assert [(r["id"], round(r["score"], 6)) for r in store.search([1.0, 0.0], 5).collect()] == [(3, 0.707107), (1, -1.0)]
    assert [(r["id"], round(r["score"], 6)) for r in store.search_words("Red", [0.0, 2.0], 5).collect()] == [(3, 0.707107)]
    assert store.search([0.0, 0.0], 5).count() == 0 and [r["score"] for r in store.search_words("blue", [0.0, 0.0], 5).collect()] == [0.0]
    assert [r["id"] for r in store.search([1.0, 0.0], 5, F.col("doc") == 1).collect()] == [1]
    store.delete_documents(spark.createDataFrame([(2,)], "doc bigint"))
    assert store.count() == 1 and store.search_words("red", [1.0, 0.0], 5).count() == 0
    with pytest.raises(vector_store.Refused):
        store.search([1.0, 2.0, 3.0], 1)


def test_hashed_embedding_against_a_plain_count(spark):
    def plain(text):
        v = [0.0] * 16
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            if w not in vector_store.STOP_WORDS:
                h = 2166136261
                for c in w:
                    h = (h ^ ord(c)) * 16777619 % 2**32
                v[h % 16] += 1
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v]

    texts = {1: "The bid of the city, the BID", 2: "uma obra", 3: "de da do", 4: "", 5: None}
    got = {r["id"]: r["vector"] for r in vector_store.hashed_embedding(docs(spark, list(texts.items())), "id", "text", 16).collect()}
    assert set(got) == {1, 2} and all(abs(x - y) < 1e-12 for i in got for x, y in zip(got[i], plain(texts[i]), strict=True))
