"""Classes of videos, legal acts, errors and drawings; matches of votes with projects; values promoted from summaries; dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import term_start
from ..functions.text import fold_lower, line_quality
from .notices import let

# Labels of legal acts (folded, in single blanks) and their types.
ACTS = {
    "decreto": "decreto", "lei ordinaria": "lei_ordinaria", "lei complementar": "lei_complementar", "portaria": "portaria", "resolucao": "resolucao", "instrucao normativa": "instrucao_normativa", "lei organica": "lei_organica",
    "atas": "ata", "regimento interno": "regimento_interno", "estatuto": "estatuto", "ata de comissao": "ata_comissao", "projeto de lei": "projeto_lei", "lei": "lei", "deliberacao": "deliberacao", "decreto legislativo": "decreto_legislativo",
    "portaria do legislativo": "portaria_legislativo", "projeto de lei complementar": "projeto_lei_complementar", "oficio": "oficio", "indicacao": "indicacao", "requerimento": "requerimento", "ata ordinaria": "ata_ordinaria",
    "ata extraordinaria": "ata_extraordinaria", "ata solene": "ata_solene", "ata audiencia publica": "ata_audiencia_publica", "ato da mesa": "ato_da_mesa", "emenda a lei organica": "emenda_lei_organica",
    "projeto de lei substitutivo": "projeto_lei_substitutivo", "projeto de resolucao": "projeto_resolucao", "projeto de emenda a lei organica": "projeto_emenda_lei_organica",
}
OTHER_ACT = "documento_publico"
# What messages of errors say, in order, and what passes by itself.
ERRORS = (
    ("limite_tamanho", "maxcontentlength|maxbodylength|excede o limite|limite de disco|limite seguro|limite de texto|limite de .* caracteres"),
    ("revisao_fonte", "exige revisao|cobertura incompleta|nao consta na citacao|fonte mudou|checkpoint .* invalido|texto_baixa_qualidade_ocr|ausencia de tabela contradiz|documento sem arquivo oficial"),
    ("modelo_indisponivel", r"\b410\b|end of life|model[^\n]{0,80}not found|not found[^\n]{0,40}model"), ("timeout", "timeout|timed out"), ("limite_provider", "429|rate limit|too many requests"),
    ("contrato_rejeitado", r'^\s*\[\s*\{(?s:.*)"code"\s*:(?s:.*)"path"\s*:'), ("contrato_invalido", "contrato|zod|invalid|expected|required"), ("fonte_bloqueada", r"\bpncp http 403\b"),
    ("credencial", "api key|unauthorized|401|403"), ("rede", "network|fetch|connect|econn|enotfound|eai_again"), ("limite_tamanho", "chunks"),
)
TRANSIENT = r"econnreset|etimedout|eai_again|econnrefused|sqlite_busy|timeout|timed out|worker_interrupted|http (?:429|5[0-9][0-9])|\b429\b|\b50[0234]\b|ia nao (?:retornou|contem) json valido"
# A project's type and how matters name it.
PROJECTS = {"projeto_lei": "projeto de lei", "projeto_lei_complementar": "projeto de lei complementar", "projeto_lei_substitutivo": "projeto de lei substitutivo", "projeto_resolucao": "projeto de resolucao", "projeto_emenda_lei_organica": "emenda a lei organica"}


def video(title: Column) -> Column:
    """struct(kind, number) of a session's video by its title."""
    p = r"(?iu)^\s*([0-9]+)\s*[ªaº°]?\s*Sess[ãa]o\s+(Extraordin[áa]ria|Ordin[áa]ria)"
    name = F.lower(F.regexp_extract(title, p, 2))
    kind = F.when(name.startswith("extra"), "sessao_extraordinaria").when(name != "", "sessao_ordinaria").when(title.rlike(r"(?iu)audi[êe]ncia\s+p[úu]blica"), "audiencia_publica").otherwise("outro")
    return F.struct(kind.alias("kind"), F.regexp_extract(title, p, 1).try_cast("int").alias("number"))


def act_type(label: Column) -> Column:
    """The type of a legal act by its label; public document if the label is none of those known."""
    key = F.trim(F.regexp_replace(fold_lower(F.coalesce(label, F.lit(""))), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in ACTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(OTHER_ACT))


def error_class(message: Column) -> Column:
    """The class of the first rule that a message meets."""
    m = F.lower(message)
    out = F.when(F.coalesce(message, F.lit("")) == "", "sem_erro")
    for name, p in ERRORS:
        out = out.when(m.rlike(p), name)
    return out.otherwise("outro")


def is_transient(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(TRANSIENT), F.lit(False))


def clean_snippet(text: Column, most: int = 280) -> Column:
    """The first characters of a text from its first line with content, or from its beginning if none has any; null without any."""
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: F.coalesce(line_quality(x), F.lit(False))), F.lit(True)).cast("int")
    body = let(first, lambda k: F.array_join(F.when(k > 0, F.slice(lines, k, F.lit(1 << 30))).otherwise(lines), " "))
    return F.nullif(F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, most), F.lit(""))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects in order; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def json_changed(a: Column, b: Column) -> Column:
    """Whether two JSON texts differ in more than the order of keys; the order of lists, types and nulls count."""
    return ~canonical_json(a).eqNullSafe(canonical_json(b))


# drawings

# Words of drawings and of prose.
DRAWING_WORDS = (
    "planta baixa", "corte", "fachada", "escala", "detalhe", "legenda", "quadro de cargas", "diagrama", "isometrico", "locacao", "nivel", "eixo", "rua", "pavimento", "alvenaria", "cobertura", "perfil longitudinal", "curva de nivel",
)
PROSE_WORDS = ("edital de licitacao", "ata da sessao", "memorial descritivo", "termo de referencia", "objeto da contratacao", "contratada devera", "processo licitatorio")


def text_shape(text: Column) -> Column:
    """struct(n_lines, n_sentences, mean_line, short_tokens, n_coordinates, n_drawing, n_prose) of a text.

    Lines are those with anything but blanks. A sentence is a line with eight words of three
    letters or more and a sign at its end; ``short_tokens`` is the share of runs of letters and digits of at most three.
    """
    t = F.coalesce(text, F.lit(""))

    def of(lines: Column) -> Column:
        words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike("[A-Za-zÀ-ÿ]{3,}")))
        sentences = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?;:]$") & (words(x) >= 8)))
        runs = F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÿ0-9]+"), F.lit(0))
        folded = fold_lower(t)
        said = lambda ws: reduce(Column.__add__, [F.contains(folded, F.lit(w)).cast("int") for w in ws])
        return F.struct(
            F.size(lines).alias("n_lines"), sentences.alias("n_sentences"), F.when(F.size(lines) > 0, F.aggregate(lines, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)) / F.size(lines)).otherwise(0.0).alias("mean_line"),
            let(runs, lambda r: F.when(F.size(r) > 0, F.size(F.filter(r, lambda x: F.length(x) <= 3)) / F.size(r)).otherwise(0.0)).alias("short_tokens"),
            F.size(F.regexp_extract_all(t, F.lit(r"\b[0-9]{1,4}[,.][0-9]{2,4}\b"), F.lit(0))).alias("n_coordinates"), said(DRAWING_WORDS).alias("n_drawing"), said(PROSE_WORDS).alias("n_prose"),
        )

    return let(F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), of)


def drawing_score(shape: Column, plate_name: Column, prose_name: Column) -> Column:
    """How much speaks for a drawing: five and a drawing's name, without a prose name, make one."""
    many = shape["n_lines"] >= 20
    part = lambda c, n: F.when(c, n).otherwise(0)
    return (
        part(plate_name, 3) + F.when(shape["n_drawing"] >= 4, 3).when(shape["n_drawing"] >= 2, 1).otherwise(0) + part(shape["short_tokens"] >= 0.42, 2) + part(shape["n_coordinates"] >= 20, 2)
        + part(many & (shape["mean_line"] < 45), 1) + part(many & (shape["n_sentences"] / shape["n_lines"] < 0.08), 1) + part(prose_name, -6) + part(shape["n_prose"] >= 1, -3)
    )


# votes and projects


def _named(projects: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """project, label, number, year of projects; vote, vote_year, label, number of what votes name in matter and excerpt."""
    norm = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(fold_lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    names = "|".join(sorted(PROJECTS.values(), key=len, reverse=True))
    label = F.create_map(*[F.lit(x) for pair in PROJECTS.items() for x in pair])
    p = rf"\b({names}) n 0*([0-9]+)\b"
    matter = norm(F.col("matter"))
    said = F.arrays_zip(F.regexp_extract_all(matter, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(matter, F.lit(p), F.lit(2)).alias("b"))
    held = F.regexp_extract_all(norm(F.col("excerpt")), F.lit(r"\b(?:n|numero) 0*([0-9]+)\b"), F.lit(1))
    each = votes.select("vote", "year", held.alias("held"), F.explode(F.array_distinct(said)).alias("s")).filter(F.array_contains("held", F.col("s.b")))
    each = each.select("vote", F.col("year").alias("vote_year"), F.col("s.a").alias("label"), F.col("s.b").try_cast("bigint").alias("number"))
    mine = projects.select("project", F.try_element_at(label, F.col("kind")).alias("label"), F.col("number").cast("bigint").alias("number"), "year").filter("label IS NOT NULL AND number IS NOT NULL")
    return mine, each


def _in_term(year: Column, vote_year: Column) -> Column:
    return (vote_year >= year) & (term_start(vote_year) == term_start(year))


def project_votes(projects: DataFrame, votes: DataFrame) -> DataFrame:
    """project, vote of the votes on a project: (project, kind, number, year) and (vote, matter, excerpt, year).

    The matter names kind and number, the vote's excerpt holds the number, too, and the year is in the
    project's term and not before it. Matters are cut into the numbers that they name, so the join is by kind and number.
    """
    mine, each = _named(projects, votes)
    return mine.join(each, ["label", "number"]).filter(_in_term(F.col("year"), F.col("vote_year"))).select("project", "vote").distinct()


def project_vote_counts(projects: DataFrame, votes: DataFrame) -> DataFrame:
    """project, n_votes, first_vote: how many votes ``project_votes`` finds on a project, and the least of them.

    A project has one kind, number and year. Votes are counted once for all projects that share them, so
    no pair of project and vote is written out.
    """
    mine, each = _named(projects, votes)
    of = ["label", "number", "year"]
    named = mine.select(*of).distinct().join(each, ["label", "number"]).filter(_in_term(F.col("year"), F.col("vote_year")))
    counts = named.groupBy(*of).agg(F.countDistinct("vote").alias("n_votes"), F.min("vote").alias("first_vote"))
    return mine.distinct().join(counts, of).select("project", "n_votes", "first_vote")


# dossiers


def latest(rows: DataFrame, group: list[str], dates: list[str], key: str) -> DataFrame:
    """The row of each group whose first known date of the chain is the last; rows without any date stand behind all others."""
    day = F.coalesce(*[F.col(d).cast("date") for d in dates])
    best = F.max_by(F.struct(*rows.columns), F.struct(day.isNotNull(), day, F.col(key)))
    return rows.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(best.alias("r")).select("r.*")


def dossier_sample(entries: DataFrame, payee: str, value: str, day: str, key: str, n: int) -> DataFrame:
    """Of each payee's entries half of ``n`` by value, the rest by recency among those not taken yet, with the part each was taken for."""
    top = (n + 1) // 2
    by_value = Window.partitionBy(payee).orderBy(F.desc(value), key)
    ranked = entries.withColumn("_v", F.row_number().over(by_value))
    recent = Window.partitionBy(payee, F.col("_v") <= top).orderBy(F.desc(day), key)
    ranked = ranked.withColumn("_d", F.row_number().over(recent))
    kept = ranked.filter((F.col("_v") <= top) | (F.col("_d") <= n - top))
    return kept.withColumn("part", F.when(F.col("_v") <= top, "value").otherwise("recent")).drop("_v", "_d")


def dossier_totals(entries: DataFrame, payee: str, value: str, day: str, unit: str) -> DataFrame:
    """payee, n, total, first_day, last_day, n_units, top_unit, top_share of each payee, from sums by unit."""
    sums = entries.groupBy(payee, unit).agg(F.count("*").alias("n"), F.sum(value).alias("v"), F.min(day).alias("a"), F.max(day).alias("b"))
    best = F.max_by(F.col(unit), F.struct(F.col("v"), F.col(unit)))
    out = sums.groupBy(payee).agg(F.sum("n").alias("n"), F.sum("v").alias("t"), F.min("a").alias("first_day"), F.max("b").alias("last_day"), F.count("*").alias("n_units"), best.alias("top_unit"), F.max("v").alias("m"))
    return out.select(payee, "n", F.col("t").cast("double").alias("total"), "first_day", "last_day", "n_units", "top_unit", F.round(F.col("m").cast("double") / F.col("t").cast("double"), 6).alias("top_share"))
