"""The ten operators: awkward inputs, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from awkward_rows import awkward_rows, prose
from civiledger.llm import bpe, bwt, decontamination, license_scan, minhash, packing, pii, quality_model, quality_rules, repeats, tagger, token_counts, token_files
from civiledger.llm.bpe import load_tokenizer, tokenizer_path, word_ids
from civiledger.llm.common import scratch_path
from civiledger.llm.components import components
from comparing import SF, duck_rows, rows_of
from pyspark.sql import functions as F


ROWS = awkward_rows()


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("module, name", [(quality_rules, "op1_quality_rules"), (license_scan, "op3_license_scan")])
def test_native_operators_match_sql(spark, duck, module, name):
    from civiledger.llm import registry

    got = registry.QUERIES[name](spark, SF)
    names, want = duck_rows(duck, module.ORACLE)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_quality_rules_on_awkward_rows(awkward, nothing):
    got = quality_rules.quality(awkward).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"]) if r["doc_id"] else None
        if r["doc_id"]:
            assert r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality(nothing).count() == 0
    assert quality_rules.keep_good(awkward).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_repeat_words_against_a_plain_count(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(60)]
    got = {x["doc_id"]: x["n_repeat_words"] for x in quality_rules.features(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        assert got[i] == len({k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)})


def test_thresholds_follow_the_groups(spark):
    """The same texts are outliers in a plain source and usual ones in a source of that kind; a small group leans on its language."""
    r = random.Random(12)
    plain = lambda: prose(r.randint(0, 10**6), r.randint(40, 90))
    marked = lambda: " ".join(w + r.choice([" # *", " |", " $ % &", ""]) for w in plain().split())
    rows = [(i, plain(), "en", "books") for i in range(300)] + [(300 + i, marked(), "en", "tables") for i in range(300)]
    odd = [marked() for _ in range(5)]
    rows += [(1000 + i, t, "en", "books") for i, t in enumerate(odd)] + [(2000 + i, t, "en", "tables") for i, t in enumerate(odd)]
    rows += [(3000 + i, plain(), "en", "tiny") for i in range(3)]
    rows += [(4000 + i, t, None, None) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality(docs).collect()}
    assert not any(kept[1000 + i] for i in range(5)) and all(kept[2000 + i] for i in range(5))
    assert all(kept[3000 + i] for i in range(3)) and all(kept[4000 + i] for i in range(5))
    assert sum(kept[i] for i in range(600)) > 590
    high = {x["source"]: x["symbol_rate_high"] for x in quality_rules.thresholds(quality_rules.sketches(quality_rules.features(docs))).collect()}
    assert high["tables"] > 2 * high["books"] and high["books"] < high["tiny"]
    # 300 copies more of one group leave a threshold of another where it was, up to its share of the language's sketch
    more = quality_rules.thresholds(quality_rules.sketches(quality_rules.features(docs.union(docs.filter("source = 'tables'")))))
    again = {x["source"]: x["symbol_rate_high"] for x in more.collect()}
    assert abs(again["tables"] - high["tables"]) < 0.3 * high["tables"]


def test_quality_rules_match_sql_where_groups_stand_for_themselves(spark, duck):
    """The SQL on larger tables, whose groups outweigh what they take from their languages."""
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("source", F.expr("substring(source, 1, 1)")).filter("doc_id % 2 = 0")
    duck.execute(f"CREATE OR REPLACE VIEW some_documents AS SELECT * REPLACE (source[1:1] AS source) FROM '{folder}/documents.parquet' WHERE doc_id % 2 = 0")
    names, want = duck_rows(duck, quality_rules._oracle("some_documents"))
    got = quality_rules.quality(docs)
    assert sorted(got.columns) == names and rows_of(got) == want


def test_licences(spark):
    texts = ["Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nfoo", "Released under the MIT License.", "No such thing.", None, "A strange licence applies."]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert [got[i]["licenses"] for i in range(5)] == ["Apache-2.0", "MIT", "", "", ""]
    assert (got[4]["n_unknown"], got[3]["n_sentences"]) == (1, 0)


def test_wrapped_licence_texts(spark):
    mit = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS"""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice,
 *    this list of conditions and the following disclaimer."""
    apache = """# Licensed under the Apache License, Version 2.0 (the
# "License"); you may not use this file except in compliance
# with the License. You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
    parted = "Released under the\n\nMIT license."
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, [mit, bsd, apache, parted, mit.replace("\n", "\r\n")])).collect()}
    assert [got[i]["licenses"] for i in range(5)] == ["MIT", "BSD", "Apache-2.0", "", "MIT"]
    assert "mit-grant,mit-notice,mit-warranty" in got[0]["sentence_ids"] and got[1]["sentence_ids"] == "bsd-grant,bsd-source"
    assert got[2]["sentence_ids"].startswith("apache2-name,apache2-use,apache2-copy")


def test_licence_names_tags_and_headers(spark):
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
    third = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    advert = "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software of someone.\n"
    cases = {
        "// SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;": "Apache-2.0,MIT",
        "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
        "Distributed under the MIT License. See LICENSE for more information.": "MIT",
        "MIT License\n\nCopyright (c) 2021 A B": "MIT",
        "This project is licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the BSD 3-Clause License.": "BSD-3-Clause",
        "This library is distributed under the terms of the GNU Lesser General Public License version 2.1 or later.": "LGPL-2.1-or-later",
        "All code in this repository is released under the ISC license": "ISC",
        "License: AGPL v3": "AGPL-3.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "Available under the Eclipse Public License 2.0": "EPL-2.0",
        "It is licensed under nothing we know.": "",
        "The mit of a licensed beer.": "",
        gpl: "GPL-3.0-or-later",
        bsd: "BSD-2-Clause",
        bsd + third: "BSD-3-Clause",
        bsd + advert: "BSD-4-Clause",
    }
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, list(cases))).collect()}
    assert {t: got[i]["licenses"] for i, t in enumerate(cases)} == cases
    assert got[15]["n_unknown"] == 1 and len(license_scan.known_sentences()) > 500


def test_licences_on_awkward_rows(awkward, nothing):
    got = license_scan.scan(awkward).collect()
    assert len(got) == len(ROWS) and all((r["n_sentences"], r["n_unknown"], r["sentence_ids"], r["licenses"]) == (0, 0, "", "") for r in got)
    assert license_scan.scan(nothing).count() == 0


def test_packing_holds_every_piece_once(spark, awkward, nothing):
    path, cap = tokenizer_path(packing.VOCABULARY), 64
    got = packing.pack(awkward, path, capacity=cap, groups=6).collect()
    texts = collections.Counter((i, t or "") for i, t, *_ in ROWS)
    ids = {t: [*load_tokenizer(path).encode(t, add_special_tokens=False).ids, packing.END_ID] for _, t in texts}
    want = collections.Counter()
    for (i, t), n in texts.items():
        for k, a in enumerate(range(0, len(ids[t]), cap)):
            part = ids[t][a : a + cap]
            want[i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= cap
    assert packing.pack(nothing, path).count() == 0


def test_plans_are_near_the_bound():
    r = random.Random(1)
    histogram = collections.Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    segments, report = packing.plan_packing(dict(histogram))
    assert report["sequences"] <= 1.01 * report["bound"] + 2
    assert all(sum(s * q for s, _, q in seg.slots) + seg.room == 2048 and seg.room >= 0 for seg in segments)


def test_minhash_against_all_pairs(spark):
    r, texts = random.Random(5), []
    for g in range(12):
        base = prose(g, r.randint(3, 120)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = "zz"
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    texts += [None, "", "a b", "A  b", "b a"]
    docs = docs_of(spark, texts)
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").encode().lower().split()) else set() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r_["doc_id"]: (r_["n_shingles"], r_["component_id"], r_["kept"]) for r_ in minhash.near_duplicates(docs, 4).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    assert sorted(r_["doc_id"] for r_ in minhash.one_of_each(docs, 4).collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_a_large_group_around_one_text(spark):
    """Copies that are near the original only: most pairs of them are not alike, none may be lost."""
    r, base = random.Random(9), prose(50, 120).split()
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for k in r.sample(range(len(w)), 3):
            w[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = {(a, b) for a in range(61) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    root = list(range(61))
    for _ in range(61):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(root))


def test_whole_sets_go_to_python_in_small_batches(spark, monkeypatch):
    key, plain, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", minhash.stored, {}

    def noted(df, name):
        seen[name] = int(spark.conf.get(key))
        return plain(df, name)

    before = spark.conf.get(key)
    monkeypatch.setattr(minhash, "stored", noted)
    texts = [" ".join(f"w{k % 40}" for k in range(i % 3, 60)) for i in range(30)]
    assert minhash.near_duplicates(docs_of(spark, texts)).count() == 30
    assert {"minhash-documents", "minhash-sets", "minhash-measured", "minhash-cores", "minhash-departures"} <= set(seen)
    assert max(seen.values()) <= 512 and spark.conf.get(key) == before
    hashes = minhash.WordHashes()
    for k in range(450_000):
        hashes[b"%d" % k]
    assert len(hashes) <= 200_000


def test_minhash_on_awkward_rows(awkward, nothing):
    got = minhash.near_duplicates(awkward, 4).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert of[5] == of[4] == of[6] == 4 and of[8] == 7 and of[1] == 1 and of[2] == 2
    assert minhash.near_duplicates(nothing).count() == 0
    assert minhash.one_of_each(awkward).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def naive_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and tagger.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], tagger.KINDS.index(s[2])))


def test_base_spans_against_the_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("a1..@@+- ()09bé") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == naive_spans(t)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_tagger_gradients_and_accuracy():
    model = tagger.Tagger()
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, y = tagger.examples(3)
    _, grads = model.gradients(x, y.astype(int))
    for k in ("step", "out", "fh", "bx"):
        at = tuple(s // 2 for s in model.p[k].shape)
        was = model.p[k][at]
        model.p[k][at] = was + 1e-3
        up = model.gradients(x, y.astype(int))[0]
        model.p[k][at] = was - 1e-3
        down = model.gradients(x, y.astype(int))[0]
        model.p[k][at] = was
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-2 * max(1, abs(grads[k][at]))
    x, y = tagger.examples(300, seed=99)
    tags = tagger.trained().decode(x)
    assert (tags == y).mean() > 0.95


def test_personal_data(spark, awkward, nothing):
    model = tagger.trained()
    got = pii.find(awkward, model).collect()
    assert len(got) == len(ROWS) and pii.find(nothing, model).count() == 0
    for r in got:
        if r["doc_id"]:
            base = naive_spans(next(t for i, t, *_ in ROWS if i == r["doc_id"]) or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
            assert all(f"{k}:{a}:{b}" in r["spans"] for a, b, k in base)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(awkward, model).collect() if r["doc_id"]}
    assert "<EMAIL>" in masked[12] and "<PHONE>" in masked[12] and "@" not in masked[12] and masked[1] is None
    text = "Write to bob_lee [at] mail7[dot]net, host 10[.]0[.]3[.]7 or call (743) 555-3824 today"
    more = pii.added_spans([text], [[]], model)[0]
    assert {k for *_, k in more} >= {"email", "phone"}
    clean = prose(4, 300) + " in 2021, 12 of 30 for 1.250,00 on 3/4/2020"
    assert pii.added_spans([clean], [[]], model) == [[]]


def held_out(n, seed):
    """Texts with personal data in spellings of every kind, and the spans that the patterns miss."""
    r = random.Random(seed)
    texts, missed = [], []
    for _ in range(n):
        text, tags = tagger.sample(r, r.choice([60, 300, 1500]), r.choice([0.0, 0.02, 0.1]))
        base, spans, i = pii.base_spans(text), [], 0
        while i < len(tags):
            j = i + 1
            if tags[i]:
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                if not any(a < j and b > i for a, b, _ in base):
                    spans.append((i, j, tagger.KINDS[(tags[i] - 1) // 2]))
            i = j
        texts.append(text)
        missed.append(spans)
    return texts, missed


def test_the_tagger_finds_what_patterns_miss():
    """On held-out texts: most spans that the patterns miss are found, few others are, and without the tagger none is."""
    texts, missed = held_out(300, 77)
    base = [pii.base_spans(t) for t in texts]
    model = tagger.trained()
    found = pii.added_spans(texts, base, model)
    met = lambda s, others: any(a < s[1] and b > s[0] and k == s[2] for a, b, k in others)
    n = sum(map(len, missed))
    hits = sum(met(s, f) for m, f in zip(missed, found, strict=True) for s in m)
    wrong = sum(not met(s, m) for m, f in zip(missed, found, strict=True) for s in f)
    assert n > 300 and hits > 0.8 * n and wrong < 0.05 * hits
    blind = tagger.Tagger()
    blind.p["out"] *= 0
    blind.p["step"][0, 0] = 50
    assert not any(pii.added_spans(texts, base, blind))


def test_windows_are_reconciled_over_the_whole_text():
    """Spans are found at every distance from the edges of windows, in long texts and beside other texts; passing windows over changes nothing."""
    model = tagger.trained()
    filler = prose(21, 400)
    for size in range(0, 2 * pii.STRIDE, 13):
        text = filler[:size] + " mail bob_lee (at) mail7.net or 743 555-3824 " + filler[size : size + 50]
        kinds = [k for *_, k in pii.added_spans([filler, text, "", "x"], [[], [], [], []], model)[1]]
        assert kinds.count("email") == 1, size
    texts, _ = held_out(40, 5)
    base = [[] for _ in texts]
    every = tagger.Tagger()
    every.p = model.p
    every.none_best = lambda e, margin=0: np.zeros(e.shape[2], bool)
    assert pii.added_spans(texts, base, every) == pii.added_spans(texts, base, model)
    assert pii.added_spans(texts, base, model) == [pii.added_spans([t], [[]], model)[0] for t in texts]


def test_long_addresses_are_masked_whole():
    bi = tagger.trained()
    for address in (
        "ana (at) research.example (dot) org",
        "tailmast23 (at) chstermator9 (dot) example (dot) com",
        "ioneilouermathchtaenmaiorilst.ertaou_marina (at) ionest.org",
    ):
        text = f"please write to {address} for the full report of the year"
        more = pii.added_spans([text], [pii.base_spans(text)], bi)[0]
        assert pii.masked(text, more) == "please write to <EMAIL> for the full report of the year", address
    # the end of a tagged span inside a label does not cut or lose the address
    text = "ana (at) research.example (dot) org, and more"
    assert pii._holds(text, 0, 14, "email") == pii._holds(text, 0, 25, "email") == (0, 35, "email")


def anchored_strings(r):
    """Stretches of edited copies of one text, groups and anchors."""
    letters, n = r.choice([b"a", b"ab", b"abc\0"]), r.randint(1, 12)
    base = bytes(r.choice(letters) for _ in range(r.randint(1, 90)))
    strings, anchors = [], []
    for _ in range(n):
        copy = bytearray(base)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(len(copy))] = r.choice(letters)
        a = r.randint(0, len(copy))
        strings.append(bytes(copy[a : r.randint(a, len(copy))]))
        anchors.append(r.choice([60, 90]) - a)
    groups = np.unique(np.sort([r.randint(0, 2) for _ in range(n)]), return_inverse=True)[1]
    return strings, np.array(anchors), groups, np.array([r.random() < 0.3 for _ in range(n)])


def test_merged_transforms_against_counts():
    r = random.Random(5)
    for _ in range(150):
        strings, anchors, groups, known = anchored_strings(r)
        depth = 8 * r.randint(1, 4)
        seen = collections.Counter((g, i - a, s[i : i + depth]) for s, a, g in zip(strings, anchors, groups, strict=True) for i in range(len(s) - depth + 1))
        want = [
            [] if k else [i for i in range(len(s) - depth + 1) if seen[g, i - a, s[i : i + depth]] > 1]
            for s, a, g, k in zip(strings, anchors, groups, known, strict=True)
        ]
        for shards, width in ((1, 8), (2, 8), (3, 8), (2, depth)):
            assert [x.tolist() for x in bwt.repeated(strings, anchors, groups, known, depth, shards, width)] == want


def test_words_of_one_hash_stay_apart(monkeypatch):
    raw = np.frombuffer(bytes(range(200)) * 2, np.uint8)
    starts = np.arange(0, 350)
    want = np.unique([raw[s : s + 16].tobytes() for s in starts], return_inverse=True)[1]
    same = lambda a, b: len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))
    assert same(bwt.word_codes(raw, starts, 16), want)
    real, calls = np.unique, []

    def clash(x, **kw):
        calls.append(x.ndim)
        return real(x & np.uint64(1) if x.ndim == 1 else x, **kw)

    monkeypatch.setattr(bwt.np, "unique", clash)
    assert same(bwt.word_codes(raw, starts, 16), want) and calls == [1, 2]


def test_the_merge_needs_sorted_shards_and_stops_by_itself():
    """Shards in any other order give wrong repeats; without common prefixes refinement ends early."""
    r = random.Random(6)
    strings = [bytes(r.choice(b"abcd") for _ in range(r.randint(30, 60))) for _ in range(6)]
    strings += [s[:20] + s[24:] for s in strings] + [s[:9] + b"x" + s[10:] for s in strings]
    sizes, anchors, groups = np.array([len(s) for s in strings]), np.zeros(18, int), np.zeros(18, int)
    made = bwt.transforms(np.frombuffer(b"".join(strings), np.uint8), sizes, anchors, groups, np.arange(18) % 2, 8)
    right, rounds = bwt.merged(made, np.zeros(len(made.place), bool), 16, 8)
    assert len(right) and rounds == sorted(rounds, reverse=True)
    # the same columns and shards, but no order of suffixes within them
    mixed = np.lexsort([np.random.default_rng(1).random(len(made.place)), made.shard, made.block])
    back = np.empty_like(mixed)
    back[mixed] = np.arange(len(mixed))
    wrong = bwt.Shards(made.place[mixed], made.block[mixed], made.shard[mixed], made.transform[mixed], back[made.earlier[mixed]].astype(np.int32))
    got, _ = bwt.merged(wrong, np.zeros(len(made.place), bool), 16, 8)
    assert sorted(wrong.place[got]) != sorted(made.place[right])
    apart = [bytes(r.choice(range(256)) for _ in range(300)) for _ in range(4)]
    made = bwt.transforms(np.frombuffer(b"".join(apart), np.uint8), np.full(4, 300), np.zeros(4, int), np.zeros(4, int), np.arange(4) % 2, 8)
    hits, rounds = bwt.merged(made, np.zeros(len(made.place), bool), 200, 8)
    assert not len(hits) and len(rounds) < 5


def plain_removal(texts, depth=repeats.DEPTH):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + depth] for b in raws for i in range(len(b) - depth + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - depth + 1):
            if seen[b[i : i + depth]] > 1:
                gone[i : i + depth] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [repeats.GROUP_STRINGS, 4, 1])
def test_repeats_against_a_plain_count(spark, most, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_STRINGS", most)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    r, passage = random.Random(2), prose(90, 70)
    texts = [prose(i, 60) + passage[r.randint(0, 60) :] + prose(100 + i, 30) for i in range(14)]
    texts += [texts[0], None, "", "x" * 199, "y" * 450, "é" * 150, "ab" * 200, texts[1][:250], texts[2][50:252], texts[3][50:249]]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeats.without_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts)


def test_repeats_on_awkward_rows(spark, awkward, nothing, monkeypatch):
    got = repeats.without_repeats(awkward).drop("kept").collect()
    want = collections.Counter(zip([i for i, *_ in ROWS], plain_removal([t for _, t, *_ in ROWS]), strict=True))
    assert collections.Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want
    assert repeats.without_repeats(nothing).count() == 0


def test_slabs_do_not_change_runs(monkeypatch):
    text = (prose(1, 3000) + "\n").encode()
    raw = np.frombuffer(text, np.uint8)
    whole = {int(f + k) for _, first, n, *_ in repeats.runs_of(raw, np.array([0]), np.array([len(raw)])) for f, c in zip(first, n, strict=True) for k in range(c)}
    monkeypatch.setattr(repeats, "SLAB", 1000)
    cut = collections.Counter(int(f + k) for _, first, n, *_ in repeats.runs_of(raw, np.array([0]), np.array([len(raw)])) for f, c in zip(first, n, strict=True) for k in range(c))
    assert set(cut) == whole == set(range(len(raw) - repeats.DEPTH + 1)) and set(cut.values()) == {1}


def test_quality_model(spark, awkward, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.fit_model(docs, labels)
    got = {r["doc_id"]: r for r in quality_model.score_documents(docs, model).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(got[i]["score"], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    again = quality_model.fit_model(docs, labels)
    assert np.array_equal(again.tables[2], model.tables[2])
    scored = quality_model.score_documents(awkward, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert quality_model.score_documents(nothing, quality_model.fit_model(nothing, labels)).count() == 0
    assert quality_model.score_documents(awkward, quality_model.AdditiveModel()).first()["score"] == 0.5


def test_quality_model_labels_and_copies(spark):
    """Repeated labels and copies of labelled documents change nothing; null and contrary labels are no failure."""
    docs = docs_of(spark, [prose(i, 30 + i % 9) + (" ### ###" * 9 if i % 3 == 0 else "") for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)] + [(5, None), (None, 1), (7, 0)], "doc_id bigint, quality int")
    once = quality_model.fit_model(docs, labels)
    again = quality_model.fit_model(docs.union(docs).union(docs).union(docs).union(docs), labels.union(labels))
    assert all(np.array_equal(a, b) for a, b in zip(once.tables, again.tables, strict=True)) and once.base == again.base
    x = np.array([quality_model.features(r["text"]) for r in docs.collect()])
    plain = [once.base + sum(t[int(np.searchsorted(c, v, side="left"))] for c, t, v in zip(once.cuts, once.tables, row, strict=True))
             + sum(t[int(np.searchsorted(once.pair_cuts[f], row[f], side="left")), int(np.searchsorted(once.pair_cuts[g], row[g], side="left"))] for f, g, t in once.pairs) for row in x]
    assert np.allclose(once.score(x), 1 / (1 + np.exp(-np.array(plain))))
    got = {r["doc_id"]: r["score"] for r in quality_model.score_documents(docs, once).collect()}
    assert min(got[i] for i in range(120) if i % 3) > max(got[i] for i in range(0, 120, 3))


def test_token_counts_and_prefixes(spark, awkward, nothing):
    path = tokenizer_path(token_counts.VOCABULARY)
    library = load_tokenizer(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(awkward, path, 512).collect() if r["doc_id"]}
    for i, t, *_ in ROWS:
        if i:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
            fit = (t or "").encode()[: got[i]["fit_bytes"]].decode()
            assert len(library.encode(fit, add_special_tokens=False).ids) <= 512
    assert token_counts.token_counts(nothing, path, 512).count() == 0
    some = [r for r in token_counts.prefix_counts(awkward, path).collect() if r["doc_id"] in (6, 9, 13)]
    for r in some:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"])
        counts = np.frombuffer(r["counts"], "<i4")
        for k in range(1, len(text), 7):
            assert counts[len(text[:k].encode()) - 1] == len(library.encode(text[:k], add_special_tokens=False).ids)


def test_counts_come_from_the_prefix_tables(monkeypatch):
    path = tokenizer_path(token_counts.VOCABULARY)
    library = load_tokenizer(path)

    def refuse(path):
        raise AssertionError("the library is the check, not the method")

    monkeypatch.setattr(bpe, "load_tokenizer", refuse)
    texts = [t for _, t, *_ in ROWS]
    got = [sum(counts) for _, counts in bpe.PrefixCounts(path).unit_ends(texts)]
    assert got == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_whole_counts_keep_no_tables_and_go_on_from_common_prefixes():
    counts = bpe.PrefixCounts(tokenizer_path(token_counts.VOCABULARY))
    words = [" inter", " international", " internationally", " interxq", "naïve", "naïves", "日本", "日本語", "a" * 70, "a" * 71, "!!", "!!!"]
    assert counts._piece_totals(set(words)) == {w: counts.piece(w.encode())[-1] for w in words}
    texts = ["  two blanks\n\nand  \n", "a <|endoftext|> b", "don't stop ... 12345 \t", None, "", "word words wordless"] + words
    fresh = bpe.PrefixCounts(tokenizer_path(token_counts.VOCABULARY))
    assert [sum(n) for _, n in fresh.unit_ends(texts)] == [int(counts.prefixes(t)[-1]) if t else 0 for t in texts]
    plain = bpe.PrefixCounts(tokenizer_path(token_counts.VOCABULARY))
    plain.unit_ends(["word words wordless"])
    assert not plain.known and not plain.done  # a unit's count is kept, not its table


def test_token_files_send_few_rows_to_python_at_once(spark, awkward, monkeypatch):
    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], token_files.stored
    before = spark.conf.get(key)
    monkeypatch.setattr(token_files, "stored", lambda df, name: seen.append(int(spark.conf.get(key))) or write(df, name))
    token_files.write_token_files(awkward, scratch_path(spark, "files"), tokenizer_path(token_files.VOCABULARY), token_files.END_ID)
    assert max(seen) <= 512 and spark.conf.get(key) == before


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(spark, awkward, nothing, kind):
    path = tokenizer_path(token_files.VOCABULARY)
    manifest = token_files.write_token_files(awkward, scratch_path(spark, "files"), path, token_files.END_ID, kind, 500)
    got = token_files.read_token_files(manifest).collect()
    library, at = load_tokenizer(path), 0
    lengths = {}
    for i, t, *_ in ROWS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        lengths.setdefault(i, collections.Counter())[len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] or -1 for r in sorted(got, key=lambda r: r["start"])] == sorted(i or -1 for i, *_ in ROWS)
    seen = {}
    for r in got:
        seen.setdefault(r["doc_id"], collections.Counter())[r["n_tokens"], r["ids_crc32"]] += 1
    assert seen == lengths
    empty = token_files.write_token_files(nothing, scratch_path(spark, "files"), path, token_files.END_ID)
    assert token_files.read_token_files(empty).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, np.uint32)
    for kind in ("byte", "bit"):
        assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, kind), len(ids), kind), ids)


def test_word_ids_are_the_library_s():
    path = tokenizer_path(packing.VOCABULARY)
    r = random.Random(2)
    texts = ["".join(r.choice("aZ é.,,!'0 9\n\t\x1c\x85 İßΣ…-<|​﻿　ǆ") for _ in range(r.randint(0, 30))) for _ in range(2000)] + [None, "", "it's. don't, x. ... a., 5."]
    want = [np.array(e.ids, "<u4").tobytes() for e in load_tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert word_ids(path).encode(texts) == want


def test_a_word_is_kept_once_whatever_signs_are_behind_it():
    path = tokenizer_path(packing.VOCABULARY)
    texts = ["zwolf, zwolf. Zwolf!! zwolf", " \n", None, "zwolf\x0bzwolf,", "2.0. 2.0"]
    encoder = bpe.WordIds(path)
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in load_tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert {w for w in encoder.known if "zwolf" in w} == {"zwolf"}


def contaminated(texts, items):
    out = {}
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in items for w in decontamination.words(t)}), 1)}
    for r, t in enumerate(texts):
        ids = [vocabulary.get(w, 0) for w in decontamination.words(t)]
        for i, item in items:
            x = [vocabulary[w] for w in decontamination.words(item)]
            # the plain table of edit distances to any stretch
            above = [0] * (len(ids) + 1)
            for a in range(1, len(x) + 1):
                row = [a]
                for b in range(1, len(ids) + 1):
                    row.append(min(above[b] + 1, row[b - 1] + 1, above[b - 1] + (x[a - 1] != ids[b - 1])))
                above = row
            if min(above) <= decontamination.edits_of(len(x)):
                out[r, i] = min(above)
    return out


def test_decontamination_against_all_distances(spark):
    r = random.Random(4)
    items = [(i, prose(200 + i, r.randint(10, 40))) for i in range(8)]
    texts = []
    for k in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randint(0, len(w) // 4)):
            w[r.randrange(len(w))] = r.choice(["the", "ou", "zz"])
        texts.append(prose(k, 30) + (" " + " ".join(w) if k % 2 else "") + " " + prose(900 + k, 20))
    texts += [None, "", items[0][1], items[1][1].upper().replace(" ", ", ")]
    bench = spark.createDataFrame([*items, (99, "too short"), (98, None)], "item_id int, text string")
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontamination.leaks(docs_of(spark, texts), bench).collect()}
    want = contaminated(texts, items)
    exact = {k for k, d in want.items() if d == 0}
    assert set(got) <= set(want) and exact <= set(got) and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got)
    kept = {x["doc_id"] for x in decontamination.without_leaks(docs_of(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {k for k, _ in got}


def test_edited_copies_of_long_items_are_found():
    r = random.Random(8)
    items = [(i, decontamination.words(prose(500 + i, n))) for i, n in enumerate([100, 120, 150, 200, 250])]
    index = decontamination.Index(items)
    texts, want = [], []
    for k in range(100):
        i, x = items[k % len(items)]
        w = list(x)
        w[0] = "zz"
        for _ in range(decontamination.edits_of(len(x)) - 1):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind > 0)] = ["zz"] * (kind < 2)
        # some stand at the very start or end of their text
        texts.append(" ".join([*(prose(k, 30).split() if k % 3 else []), *w, *(prose(900 + k, 20).split() if k % 4 else [])]))
        want.append((k, i))
    assert {(row, i) for row, i, *_ in index.matches(texts)} >= set(want)
    assert all(c.recall >= decontamination.RECALL or c.pieces for c in index.classes)


def test_short_items_are_found_exactly(spark):
    """Items of one to nine words, verbatim and with their one edit if they allow any, also across punctuation and at the ends."""
    r = random.Random(15)
    items = [(n, " ".join(f"q{n}w{i}" for i in range(n))) for n in range(1, 10)] + [(50, "?!")]
    texts, want = [], set()
    for n, t in items[:-1]:
        for k in range(12):
            w = t.split()
            edits = k % 3
            for _ in range(min(edits, 1) if n < 10 else 0):
                w[r.randrange(len(w))] = "other"
            if edits == 2:
                w.insert(len(w) // 2, "more")
            d = len(texts)
            texts.append(" ".join([*(prose(d, 6).split() if k % 2 else []), *[x.upper() + "," for x in w], *(prose(d + 900, 5).split() if k % 4 else [])]))
            pattern = decontamination.Pattern([hash(x) for x in t.split()])
            if pattern.distance([hash(x) for x in decontamination.words(texts[-1])]) <= decontamination.edits_of(n):
                want.add((d, n))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(docs_of(spark, texts), bench).collect()}
    assert {g for g in got if g[1] < 6} == {g for g in want if g[1] < 6} and got <= want and len(got) >= 0.97 * len(want) and len(want) > 50


def test_decontamination_on_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, prose(1, 40)), (1, prose(1, 40))], "item_id bigint, text string")
    got = decontamination.leaks(awkward, bench).collect()
    assert sorted(r["doc_id"] for r in got) == [4, 4, 5, 6] and {r["distance"] for r in got} == {0}
    assert decontamination.leaks(nothing, bench).count() == 0
    assert decontamination.leaks(awkward, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(awkward, bench).count() == len(ROWS) - 4


def test_blocks_split_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    items = [(i, prose(300 + i, 20)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.leaks(docs_of(spark, [t for _, t in items]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(i, i) for i in range(12)}

