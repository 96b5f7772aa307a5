"""Counts of votes on projects that share kind, number and year, without the pairs of both."""

from civiledger.operators import classify


def join_rows(df) -> int:
    """The most rows that a join of the plan has put out."""

    def walk(plan) -> int:
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        metrics, children = plan.metrics(), plan.children()
        own = metrics.apply("numOutputRows").value() if "Join" in name and metrics.contains("numOutputRows") else 0
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_votes_are_counted_once_for_projects_alike(spark):
    projects = [(i, ("projeto_lei", "projeto_resolucao", None)[i % 3 if i % 50 else 2], i % 2 + 7, 2021 + i % 3) for i in range(600)] + [(0, None, 7, 2021), (3, "projeto_lei", 8, 2021), (900, "projeto_lei", 7, None)]
    votes = [(i, ("Projeto de Lei nº 07", "Projeto de Lei n. 8 e Projeto de Resolução nº 7", "Moção")[i % 3], "aprovado o nº 7 e o número 08" if i % 5 else "n. 8", 2019 + i % 5) for i in range(400)] + [(5, "Projeto de Lei nº 8", "nº 8", 2022)]
    p = spark.createDataFrame(projects, "project int, kind string, number int, year int")
    v = spark.createDataFrame(votes, "vote int, matter string, excerpt string, year int")
    want = {}
    for r in classify.project_votes(p, v).collect():
        want.setdefault(r["project"], set()).add(r["vote"])
    counts = classify.project_vote_counts(p, v)
    got = counts.collect()
    assert len(want) > 200 and sorted((r["project"], r["n_votes"], r["first_vote"]) for r in got) == sorted((k, len(x), min(x)) for k, x in want.items())
    assert join_rows(counts) < 4_000 < sum(map(len, want.values()))
