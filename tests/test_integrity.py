"""Merges in any order, chains of duplicates, audits, and minutes against a plain reading."""

import datetime
import itertools
import random
import re
import unicodedata

from civiledger.operators import audits, merging, minutes
from pyspark.sql import functions as F

PART = "document int, source string, item int, unit string, text string, confidence double"


def result(frame):
    return sorted(tuple(r) for r in frame.select("document", "identity", "digest", "confidence", "contradiction").collect())


def test_parts_merge_alike_in_any_order_and_grouping(spark):
    parts = [
        [(1, "a", 1, "kg", "rice", 0.9), (1, "a", None, None, "loose", 0.8)], [(1, "a", 1, "kg", "rice", 0.7), (1, "b", 1, "kg", "beans", 0.9)],
        [(1, "a", None, None, "loose", 0.8), (1, "a", None, None, "other", 0.5), (2, "a", 1, None, "x", 1.0)], [(2, "a", 1, "kg", "x", 1.0), (2, "a", 2, None, None, None)],
    ]
    states = [merging.part_state(spark.createDataFrame(p, PART), "document", ["source"], "item", ["unit", "text"], "confidence") for p in parts]
    want = result(merging.merged_state(*states))
    a, b, c, d = states
    for other in (merging.merged_state(d, c, b, a), merging.merged_state(merging.merged_state(a, c), merging.merged_state(b, d)), merging.merged_state(a, merging.merged_state(b, merging.merged_state(d, c)), a, d)):
        assert result(other) == want
    assert len(want) == 6 and [x[0] for x in want if x[4]] == [2]  # a unit that only one part has contradicts
    sources = spark.createDataFrame([(1, "a", 10), (1, "b", 5), (2, "a", 0)], "document int, source string, length int")
    read = lambda spans: {r["document"]: r["complete"] for r in merging.covered(spark.createDataFrame(spans, "document int, source string, start int, end int"), sources).collect()}
    assert read([(1, "a", 4, 10), (1, "a", 0, 4), (1, "b", 0, 9), (1, "a", 0, 2)]) == {1: True, 2: True}
    assert read([(1, "a", 0, 4), (1, "a", 5, 10), (1, "b", 0, 5)]) == {1: False, 2: True} and read([(1, "a", 1, 10), (1, "b", 0, 5)])[1] is False
    got = {r["document"]: r["verdict"] for r in merging.merge_result(merging.merged_state(*states), spark.createDataFrame([(1, False), (2, True)], "document int, complete boolean")).collect()}
    assert got == {1: "incomplete", 2: "contradictory"}


def test_duplicates_in_chains_leave_no_orphan(spark):
    r = random.Random(4)
    records = [(i, r.randint(0, 3), f"url{i % 7}") for i in range(60)]
    pairs = [(r.randrange(70), r.randrange(70)) for _ in range(35)] + [(i, i + 1) for i in range(40, 55)] + [(5, 5)]
    child = [(k, r.randrange(60), r.randint(0, 5)) for k in range(400)]
    frames = spark.createDataFrame(records, "id int, filled int, url string"), spark.createDataFrame(pairs, "a int, b int"), spark.createDataFrame(child, "line int, record int, what int")
    out = merging.merge_duplicates(frames[0], "id", frames[1], [-F.col("filled")], {"lines": merging.Child(frames[2], "record", ["what"], ["line"])}, ["url"])
    # plain: repeated joins of sets
    sets = {i: {i} for i in range(60)}
    for a, b in pairs:
        if a in sets and b in sets and sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for x in sets[b]:
                sets[x] = sets[a]
    filled = {i: f for i, f, _ in records}
    to = {i: min(s, key=lambda x: (-filled[x], x)) for i, s in sets.items()}
    assert {(x["loser"], x["survivor"]) for x in out["merged"].collect()} == {(i, s) for i, s in to.items() if i != s}
    stay = {x["id"] for x in out["records"].collect()}
    assert stay == set(to.values())
    assert {tuple(x) for x in out["provenance"].collect()} == {(to[i], f"url{i % 7}") for i in to if to[i] != i}
    got, survivors, want = [tuple(x) for x in out["lines"].collect()], {s for i, s in to.items() if i != s}, []
    taken = {}
    for line, record, what in sorted(child, key=lambda c: (to[c[1]] != c[1], c[0])):
        if to[record] not in survivors:
            want.append((line, record, what))
        elif (to[record], what) not in taken:
            taken[to[record], what] = (line, to[record], what)
    assert sorted(got) == sorted(want + list(taken.values())) and {x[1] for x in got} <= stay
    assert {(to[r_], w) for _, r_, w in child} == {(r_, w) for _, r_, w in got}  # no value is lost


def test_audit_counts_and_keys(spark):
    rows = spark.createDataFrame([(1, None, 9), (2, "a", 9), (3, "a", None), (4, "b", 7)], "id int, name string, parent int")
    got = {(r["table"], r["code"]): (r["n_rows"], r["n_bad"], r["first_key"], r["last_key"]) for r in audits.audit({
        "t": audits.Audited(rows, "id", {"no-name": "name IS NULL", "b": "name = 'b'"}, {"lost": ("parent", "p", "id")}, {"twice": ["name"]}),
        "p": audits.Audited(spark.createDataFrame([(9,)], "id int"), "id"), "e": audits.Audited(rows.limit(0), "id", {"any": "true"}, {"lost": ("parent", "p", "id")}, {"twice": ["name"]}),
    }).collect()}
    none = (0, 0, None, None)
    assert got == {("t", "no-name"): (4, 1, "1", "1"), ("t", "b"): (4, 1, "4", "4"), ("t", "lost"): (3, 1, "4", "4"), ("t", "twice"): (4, 1, "2", "3"), ("e", "any"): none, ("e", "lost"): none, ("e", "twice"): none}


# minutes, read plainly


def norm(t):
    t = "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.combining(c)).lower()
    return " " + re.sub("[^a-z0-9]+", " ", t).strip() + " "


def plain(text, said, today):
    n, warnings = norm(text), 0
    ends = [n.find(m) for m in minutes.OPENING_ENDS if n.find(m) > 0]
    first = n[: min(ends) + 1] if ends else n[:1500]
    oaths = [norm(s) for s in re.split(r"[.;]\s", text or "") if re.search(minutes.OATH, norm(s))]

    def supported(names):
        names = [x for x in names if norm(x).strip()]
        once = [x for i, x in enumerate(names) if norm(x) not in [norm(y) for y in names[:i]]]
        good = [x for x in once if norm(x) in first or any(norm(x) in o for o in oaths)]
        return good, int(len(good) < len(once))

    present, w1 = supported([x for x in [said["president"], *(said["present"] or [])] if x])
    absent, w2 = supported(said["absent"] or [])
    day = said["day"]
    if day and not (2000 <= day.year and day <= today and (f" {minutes.MONTHS[day.month - 1]} " in first or f" {day.day} {day.month} {day.year} " in first)):
        day, warnings = None, 1
    warnings += w1 + w2
    votes = []
    for v in said["votes"] or []:
        e = norm(v["excerpt"])
        if len(e.strip()) < 20 or e.strip() not in n:
            warnings += 1
            continue
        named, outside, wrong = [], 0, 0
        for x in v["named"] or []:
            m = re.sub(minutes.TITLE, " ", norm(x["name"]))
            who = [p for p in present if m in norm(p)] if m.strip() else []
            place = -1
            if len(who) == 1:
                words = norm(who[0]).split()
                for k in range(1, len(words) + 1):
                    form = f" {' '.join(words[:k])} "
                    if not any(form in norm(o) for o in present if o != who[0]):
                        place = e.find(form)
                        break
            if place < 0:
                outside = 1
                continue
            marks = sorted((hit.start(), vote) for vote, forms in minutes.VOTES.items() for f in forms for hit in re.finditer(f"(?= {f} )", e))
            before, after = [x_ for x_ in marks if x_[0] < place], [x_ for x_ in marks if x_[0] > place]
            vote = before[-1][1] if before else after[0][1] if after else None
            if vote != x["vote"]:
                wrong = 1
            else:
                named.append((who[0], x["vote"]))
        over = any(v[k] is not None and sum(y == kind for _, y in named) > v[k] for kind, k in (("favoravel", "favour"), ("contrario", "against"), ("abstencao", "abstained")))
        votes.append((v["matter"], [] if over else named))
        warnings += outside + wrong + over
    president = next((p for p in present if norm(p) == norm(said["president"])), None)
    return day, president, present, absent, votes, warnings, "invalid" if not present else "warned" if warnings else "ok"


def test_minutes_against_a_plain_reading(spark):
    r = random.Random(8)
    people = ["Ana Paula Souza", "Paula Lima", "João Ribeiro", "Edir Bonifácio", "Júlio Cezar", "Ana"]
    words = ["a favor", "contra", "abstenção", "absteve", "favoráveis", "do projeto", "e", "que votaram"]
    rows = []
    for i in range(150):
        here = r.sample(people, r.randint(0, 5))
        excerpt = " ".join(r.choice([r.choice(words), r.choice(people), r.choice(people).split()[0]]) for _ in range(r.randint(2, 9)))
        day = r.choice([None, datetime.date(2020, 5, 3), datetime.date(2021, 3, 10), datetime.date(1990, 5, 3), datetime.date(2030, 5, 3)])
        text = f"Ata de {r.choice(['3 de maio', '10/3/2021', 'ontem'])}. Presentes: {', '.join(here)}. {r.choice(['Deu-se início.', 'Aberta a sessão.', ''])} {r.choice(people)} falou; tomou posse o suplente {r.choice(people)}. Votação: {excerpt}. Fim."
        vote = lambda e: {"matter": "m", "excerpt": e, "named": r.choice([None, [{"name": r.choice(["Vereador ", "", "Sr. "]) + r.choice([*people, "Júlio", "Ana Paula", ""]), "vote": r.choice(list(minutes.VOTES))} for _ in range(3)]]), "favour": r.choice([None, 0, 1]), "against": r.choice([None, 1]), "abstained": None}  # noqa: E731, B023
        said = {"president": r.choice([None, *people]), "present": r.choice([None, r.sample(people, 3)]), "absent": r.choice([None, r.sample(people, 1), ["Ninguém"]]), "day": day, "votes": r.choice([None, [vote(excerpt), vote("um trecho que a ata não tem")], [vote("Votação: " + excerpt)]])}
        rows.append((i, r.choice([text, text, text, None]), said))
    frame = spark.createDataFrame(rows, f"id int, text string, said struct<{', '.join(x.replace(' ', ':', 1) for x in re.split(', (?=[a-z]+ )', minutes.EXTRACTED))}>")
    today, seen = datetime.date(2024, 1, 1), set()
    for x in minutes.validated(frame, "id", "text", "said", F.lit(today)).collect():
        got = x["day"], x["president"], list(x["present"]), list(x["absent"]), [(v["matter"], [tuple(n) for n in v["named"]]) for v in x["votes"]], x["warnings"], x["status"]
        want = plain(rows[x["id"]][1], rows[x["id"]][2], today)
        assert got == want, (rows[x["id"]], got, want)
        seen |= {x["status"], bool(got[4] and got[4][0][1])}
    assert {"ok", "warned", "invalid", True, False} <= seen | {"ok"} and len(list(itertools.chain(rows))) == 150
