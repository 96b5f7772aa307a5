"""Minutes of sessions held against what was extracted from them: presence, day, votes and who voted how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_lower
from .notices import MONTHS, let

# What ends an opening, tells of a substitute taking office, and of a vote.
OPENING_ENDS = (" deu se inicio ", " declarou em nome de deus aberta ", " aberta a sessao ")
OPENING_LENGTH = 1500
OATH = r" (posse|empossad\w*|suplente) "
TITLE = r"^ (?:(?:vice )?presidente|vereadora?|secretari[oa]|senhora?|sr|sra) "
VOTES = {"favoravel": ("favoravel", "favoraveis", "a favor"), "contrario": ("contrario", "contrarios", "contra"), "abstencao": ("abstencao", "abstencoes", "absteve", "abstiveram", "abstevese")}
LEAST_EXCERPT = 20
EXTRACTED = "president string, present array<string>, absent array<string>, day date, votes array<struct<matter:string,excerpt:string,named:array<struct<name:string,vote:string>>,favour:int,against:int,abstained:int>>"


def spaced(c: Column) -> Column:
    """Folded words with one blank between them and around all."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold_lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def opening(norm: Column) -> Column:
    """The minutes up to where the session begins, or their first 1,500 characters."""
    first = F.array_min(F.filter(F.array(*[F.instr(norm, m) for m in OPENING_ENDS]), lambda i: i > 1))
    return F.substring(norm, F.lit(1), F.coalesce(first, F.lit(OPENING_LENGTH)))


def _supported(names: Column, first: Column, oaths: Column) -> Column:
    """The names, once each, that the opening or an oath holds."""
    keyed = F.transform(F.filter(names, lambda n: F.length(F.trim(spaced(n))) > 0), lambda n: F.struct(spaced(n).alias("k"), n.alias("n")))
    once = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1)
    good = F.filter(once, lambda x: F.contains(first, x["k"]) | F.exists(oaths, lambda o: F.contains(o, x["k"])))
    return F.transform(good, lambda x: x["n"])


def resolved(mention: Column, people: Column) -> Column:
    """The only one of the people (name, norm) whose name holds the mention; null if none or several do."""
    def one(m: Column) -> Column:
        return let(F.filter(people, lambda p: F.contains(p["norm"], m)), lambda found: F.when((F.length(F.trim(m)) > 0) & (F.size(found) == 1), F.get(found, 0)))

    return let(F.regexp_replace(spaced(mention), TITLE, " "), one)


def place_in(person: Column, excerpt: Column, people: Column) -> Column:
    """Where an excerpt holds the shortest beginning of a name that nobody else present has; 0 if it does not."""
    forms = lambda words: F.transform(words, lambda _, i: F.concat(F.lit(" "), F.array_join(F.slice(words, F.lit(1), i + 1), " "), F.lit(" ")))
    free = lambda f: ~F.exists(people, lambda o: (o["name"] != person["name"]) & F.contains(o["norm"], f))
    own = F.get(F.filter(let(F.split(F.trim(person["norm"]), " "), forms), free), 0)
    return F.coalesce(F.instr(excerpt, own), F.lit(0))


def nearest_vote(excerpt: Column, place: Column) -> Column:
    """The vote whose word stands last before a place, or first after it if none does."""
    def marks(e: Column) -> Column:
        words = F.split(e, " ")  # the first is empty: the text begins with a blank
        at = lambda i: F.length(F.array_join(F.slice(words, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)
        one = lambda w, v: F.get(F.array_compact(F.array(*[F.when(w.isin(*[x for x in forms if " " not in x]) | ((w == "favor") & (v == "a") & F.lit(name == "favoravel")), name) for name, forms in VOTES.items()])), 0)
        return F.filter(F.transform(words, lambda w, i: F.struct(at(i).alias("at"), one(w, F.coalesce(F.get(words, i - 1), F.lit(""))).alias("vote"))), lambda m: m["vote"].isNotNull())

    def near(found: Column) -> Column:
        before, after = F.filter(found, lambda m: m["at"] <= place), F.filter(found, lambda m: m["at"] > place)
        return F.coalesce(F.try_element_at(before, F.lit(-1)), F.get(after, 0))["vote"]

    return let(marks(excerpt), near)


def validated(rows: DataFrame, key: str, text: str, said: str, today: Column) -> DataFrame:
    """key, day, president, present, absent, votes (matter, named), warnings, status: only what the minutes' own text bears out.

    ``said`` is a struct as ``EXTRACTED``. A vote is left out whose excerpt the minutes do not hold, a named vote whose
    person the excerpt does not hold or whose nearest word of voting says otherwise; all
    names of a matter go where one side has more names than the tally. Status: ok, warned, or invalid without anybody present.
    """
    s = F.col(said)
    none = F.array().cast("array<string>")
    rows = rows.select(key, F.col(text).alias("_t"), s.alias("_s"))
    rows = rows.select(key, "_s", F.explode(F.array(spaced(F.col("_t")))).alias("norm"), F.filter(F.transform(F.split("_t", r"[.;]\s"), spaced), lambda x: x.rlike(OATH)).alias("oaths"))
    rows = rows.withColumns({"oaths": F.coalesce("oaths", none), "first": opening(F.col("norm"))})
    names = F.array_compact(F.concat(F.array(F.col("_s.president")), F.coalesce("_s.present", none)))
    rows = rows.withColumns({"all": names, "away": F.array_compact(F.coalesce("_s.absent", none))})
    rows = rows.select(key, "_s", "norm", "first", "all", "away", F.explode(F.array(F.struct(_supported(F.col("all"), F.col("first"), F.col("oaths")).alias("present"), _supported(F.col("away"), F.col("first"), F.col("oaths")).alias("absent")))).alias("who"))
    present = F.col("who.present")
    rows = rows.withColumn("people", F.explode(F.array(F.transform(present, lambda p: F.struct(p.alias("name"), spaced(p).alias("norm"))))))
    people = F.col("people")
    distinct = lambda a: F.size(F.array_distinct(F.transform(a, spaced)))
    d = F.col("_s.day")
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(d) - 1)
    numeric = F.concat(F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(" "), F.month(d).cast("string"), F.lit(" "), F.year(d).cast("string"), F.lit(" "))
    good_day = F.when((F.year(d) >= 2000) & (d <= today) & (F.contains("first", F.concat(F.lit(" "), month, F.lit(" "))) | F.contains("first", numeric)), d)

    def checked(v: Column) -> Column:
        excerpt = spaced(v["excerpt"])

        def judge(e: Column) -> Column:
            def one(n: Column) -> Column:
                found = let(resolved(n["name"], people), lambda full: F.struct(full["name"].alias("name"), n["vote"].alias("vote"), F.when(full.isNotNull(), place_in(full, e, people)).otherwise(0).alias("at")))
                return let(found, lambda x: F.struct(
                    x["name"].alias("name"), x["vote"].alias("vote"), (x["at"] <= 0).alias("outside"), F.when(x["at"] > 0, ~nearest_vote(e, x["at"]).eqNullSafe(x["vote"])).otherwise(False).alias("wrong")))

            def tallied(all_: Column) -> Column:
                good = F.transform(F.filter(all_, lambda x: ~x["outside"] & ~x["wrong"]), lambda x: F.struct(x["name"].alias("name"), x["vote"].alias("vote")))
                count = lambda g, kind: F.size(F.filter(g, lambda x: x["vote"] == kind))
                over = lambda g: F.coalesce((count(g, "favoravel") > v["favour"]), F.lit(False)) | F.coalesce((count(g, "contrario") > v["against"]), F.lit(False)) | F.coalesce((count(g, "abstencao") > v["abstained"]), F.lit(False))
                return let(good, lambda g: F.struct(v["matter"].alias("matter"), F.when(over(g), F.slice(g, 1, 0)).otherwise(g).alias("named"), (F.exists(all_, lambda x: x["outside"]).cast("int") + F.exists(all_, lambda x: x["wrong"]).cast("int") + over(g).cast("int")).alias("warned")))

            named = F.coalesce(v["named"], F.array().cast("array<struct<name:string,vote:string>>"))
            return let(F.transform(named, one), tallied)

        return let(excerpt, judge)

    votes = F.coalesce("_s.votes", F.array().cast(EXTRACTED.split("votes ")[1]))
    held = F.filter(votes, lambda v: (F.length(F.trim(spaced(v["excerpt"]))) >= LEAST_EXCERPT) & F.contains(F.col("norm"), F.trim(spaced(v["excerpt"]))))
    rows = rows.withColumns({"votes": F.transform(held, checked), "n_votes": F.size(votes) - F.size(held), "good_day": good_day})
    president = F.get(F.filter(present, lambda p: spaced(p) == spaced(F.col("_s.president"))), 0)
    warnings = (
        (F.size(present) < distinct(F.col("all"))).cast("int") + (F.size("who.absent") < distinct(F.col("away"))).cast("int") + (d.isNotNull() & F.col("good_day").isNull()).cast("int")
        + F.col("n_votes") + F.aggregate("votes", F.lit(0), lambda a, v: a + v["warned"])
    )
    out = rows.select(key, F.col("good_day").alias("day"), president.alias("president"), present.alias("present"), F.col("who.absent").alias("absent"), F.transform("votes", lambda v: F.struct(v["matter"].alias("matter"), v["named"].alias("named"))).alias("votes"), warnings.alias("warnings"))
    return out.withColumn("status", F.when(F.size("present") == 0, "invalid").when(F.col("warnings") > 0, "warned").otherwise("ok"))
