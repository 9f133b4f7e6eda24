import json
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark import session
from lorespark.operators import cleaning, distributions, evaluation, fidelity, integrity, mentions, ranking, traces


def test_exact_percentiles_with_ties_and_tails(spark):
    random.seed(4)
    groups = {"a": [random.gauss(0, 1) for _ in range(501)], "b": [5.0] * 300 + [1e9, -3.0], "c": [7.25], "d": [10 ** random.uniform(-9, 9) for _ in range(200)]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values] + [("a", None)], "k string, v double")
    linear = {r.k: r for r in distributions.linear_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.95}).collect()}
    nearest = {r.k: r.p for r in distributions.nearest_rank_percentiles(df, ["k"], "v", {"p": 0.95}).collect()}
    for key, values in groups.items():
        ordered, position = sorted(values), (len(values) - 1) * 0.95
        low = int(position)
        high = min(low + (position > low), len(values) - 1)
        assert linear[key].m == pytest.approx(statistics.median(values))
        assert linear[key].p == pytest.approx(ordered[low] * (1 - position + low) + ordered[high] * (position - low))
        assert nearest[key] == ordered[round(position)]
    overall = distributions.summarise(df, [], "v").first()
    assert overall["count"] == sum(map(len, groups.values()))
    empty = distributions.summarise(df.filter("false"), [], "v").first()
    assert (empty["count"], empty["mean"], empty["p95"]) == (0, 0.0, 0.0)


def test_exact_percentiles_whatever_the_cuts(spark, monkeypatch):
    """Approximate quantiles differ between two computations on a cluster: no step may see other cuts than another."""
    @F.pandas_udf("array<double>")
    def some_cuts(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sorted(random.SystemRandom().sample(list(v), 40)))

    monkeypatch.setattr(distributions.F, "percentile_approx", lambda column, *_: some_cuts.asNondeterministic()(F.collect_list(column)))
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 1009).cast("double").alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = {r.k: r for r in distributions.linear_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.95, "q": 0.7}).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for key in (0, 1):
        ordered = sorted(n * 7 % 1009 for n in range(key, 4000, 2))
        for name, fraction in (("m", 0.5), ("p", 0.95), ("q", 0.7)):
            position = (len(ordered) - 1) * fraction
            low = int(position)
            assert found[key][name] == pytest.approx(ordered[low] + (ordered[low + 1] - ordered[low]) * (position - low))


def test_usage_totals(spark):
    df = spark.createDataFrame(
        [("t", "llm", "SUCCESS", 2.0, 10, 20, 30), ("t", "llm", "ERROR", 1.0, None, None, None), ("t", "ok", "SUCCESS", 4.0, 1, 8, 9),
         ("t", None, "SUCCESS", 9.0, None, None, None)],
        "id string, llm_name string, status string, duration_seconds double, prompt_tokens long, completion_tokens long, total_tokens long")
    found = {r.llm_name: r for r in traces.usage_totals(df, ["id"]).collect()}
    assert set(found) == {"llm", "ok"}
    assert (found["llm"].calls, found["llm"].errors, found["llm"].total_tokens, found["llm"].known_total_tokens, found["llm"].tokens_per_second) == (2, 1, None, 30, None)
    assert (found["ok"].completion_tokens, found["ok"].tokens_per_second) == (8, 2.0)


def test_trace_reports(spark):
    rows = [({"router": 1.0, "main_llm": 3.0}, "PASS", 1, 0, 4.0, 3), ({"router": 3.0}, None, 0, 2, 8.0, 0), ({"retrieval": 2.0}, "PASS", 0, 0, 1.0, 0)]
    df = spark.createDataFrame(rows, "timings map<string,double>, d string, r int, g int, total_time double, n int").select(
        "timings", F.col("d").alias("grounding_decision"), F.struct(F.col("r").alias("retrieval"), F.col("g").alias("generation")).alias("retries"),
        "total_time", F.struct(F.col("n").alias("retrieved_chunks"), F.col("n").alias("context_chunks"), F.col("n").alias("context_chars")).alias("retrieval"))
    components = {r.component: r for r in traces.component_summary(df).collect()}
    assert components["router"]["count"] == 2 and components["router"]["median"] == 2.0
    retries = traces.retry_summary(df).first()
    assert (retries.retrieval_retries, retries.generation_retries, retries.traces_with_retry) == (1, 2, 2)
    assert [(r.decision, r.n) for r in traces.decision_histogram(df).collect()] == [("PASS", 2), ("N/A", 1)]
    assert {r.metric: r["median"] for r in traces.retrieval_medians(df).collect()}["retrieved_chunks"] == 1.5


def test_reviews_and_golden_lists(spark):
    schema = ("id int, review struct<reviewer:string,factually_correct:boolean,complete:boolean,unsupported_claims:boolean,"
              "abstained:boolean,abstention_appropriate:boolean>")
    unread, read = ("", None, None, None, None, None), ("x", True, False, False, False, False)
    totals = evaluation.review_summary(spark.createDataFrame([(1, unread), (2, read), (3, ("x", True, True, True, True, True))], schema)).first()
    assert (totals.total, totals.reviewed, totals.answered, totals.factually_correct, totals.complete, totals.appropriate_abstentions) == (3, 2, 1, 1, 0, 1)
    with pytest.raises(ValueError):
        evaluation.review_summary(spark.createDataFrame([(1, read), (1, read)], schema))
    with pytest.raises(ValueError):
        evaluation.review_summary(spark.createDataFrame([(1, ("x", None, True, True, True, True))], schema))
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, s string")
    assert evaluation.same_multiset(left, left.orderBy(F.desc("n"))).isEmpty()
    diff = evaluation.same_multiset(left, spark.createDataFrame([(1, "a"), (3, None)], "n int, s string")).collect()
    assert {(r.n, r.s, r.excess) for r in diff} == {(1, "a", 1), (2, None, 1), (3, None, -1)}


def test_recall(spark):
    cases = spark.createDataFrame([(1, "f", "p"), (2, "f", "q"), (3, "g", "p")], "case int, file string, path string")
    results = spark.createDataFrame([(1, "f", "p", 2), (1, "f", "p", 4), (2, "f", "q", 5), (3, "f", "p", 1)], "case int, file string, path string, rank int")
    scores = evaluation.recall_and_mrr(evaluation.first_hit_rank(cases, results, "case", ["file", "path"], "rank")).first()
    assert (scores.recall_at_1, scores.recall_at_3, scores.recall_at_5) == (0.0, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert scores.mrr == pytest.approx((1 / 2 + 1 / 5) / 3)


def test_fidelity(spark):
    answer = "Créhelf et Pierraile sont présents. Maréon n'est pas un légendaire. M. Mime compte ; Vœuil à tort"
    names = ["Créhelf", "Pierraile", "Maréon", "Vœuil", "Absent", "M. Mime", "Expuls'Organes"]
    df = spark.createDataFrame([(names, answer + " ! Expuls’Organes")], "names array<string>, answer string")
    assert fidelity.unfaithful_names(df).first().unfaithful == ["Maréon", "Vœuil", "Absent"]
    long = spark.createDataFrame([([str(n) for n in range(31)], "x"), ([], "x")], "names array<string>, answer string")
    assert [(r.status, r.unfaithful) for r in fidelity.unfaithful_names(long).collect()] == [("not checked", None)] * 2
    text = df.select(fidelity.replacement(F.lit("capacités"), F.lit(9), F.array(F.lit("a"), F.lit("b"))).alias("t")).first().t
    assert text == "D'après les données locales, 9 capacités correspondent à la question ; voici les 2 premiers : a, b."


def test_denials(spark):
    texts = ["Renard ne sont pas là", "Renard n'est pas légendaire", "Renard n’appartiennent pas", "Renard n'évolue pas", "Renard exclu", "Renard inclus"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r.a for r in df.select(fidelity.affirmed(F.lit("renard"), F.col("x")).alias("a")).collect()] == [False, False, False, True, False, True]


def test_mentions_of_long_names(spark):
    name = "-".join(f"mot{n}" for n in range(9))
    found = mentions.mentions(spark.createDataFrame([(1, "voici " + name.replace("-", " ") + " !"), (2, "mot0")], "id int, x string"), "id", "x",
                              spark.createDataFrame([(name, "Long")], "alias_key string, target string"))
    assert [(r.id, r.start, r["size"], r.target) for r in found.collect()] == [(1, 1, 9, "Long")]


def test_percentiles_keep_null_groups_and_outliers(spark):
    rows = [(None, float(v)) for v in (5, 7)] + [("a", float(v)) for v in range(3000)] + [("a", 1e300)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r["count"], r["mean"], r.median, r.p95) for r in distributions.summarise(df, ["g"], "v").filter("g IS NULL OR g = 'b'").collect()}
    assert got == {None: (2, 6.0, 6.0, pytest.approx(6.9)), "b": (0, 0.0, 0.0, 0.0)}
    ranks = {r.g: r.p50 for r in distributions.nearest_rank_percentiles(df, ["g"], "v", {"p50": 0.5}).collect()}
    assert ranks == {None: 5.0, "a": 1500.0}


def test_mentions(spark):
    aliases = spark.createDataFrame([("renard", "Renard"), ("renard-de-galar", "Renard de Galar"), ("ours", "Ours")], "alias_key string, target string")
    texts = spark.createDataFrame([(1, "Le Renard de Galar !"), (2, "renard, puis renard de galar"), (3, "tours"), (4, "ours et renard")], "id int, x string")
    found = mentions.mentions(texts, "id", "x", aliases)
    kept = sorted((r.id, r.start, r.target) for r in mentions.longest_mentions(found, "id").collect())
    assert kept == [(1, 1, "Renard de Galar"), (2, 0, "Renard"), (2, 2, "Renard de Galar"), (4, 0, "Ours"), (4, 2, "Renard")]
    assert mentions.unique_mention(found, "id").collect() == []
    assert sorted((r.id, r.target) for r in mentions.shortest_prefix_mention(found, "id").collect()) == [(1, "Renard"), (2, "Renard")]


def test_mentions_of_both_plans_equal_plain_search(spark):
    rng = random.Random(6)
    names = sorted({"-".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(25)})
    texts = [(n, " ".join(rng.choices(["A", "b", "C!", "é", "ab"], k=rng.randrange(12)))) for n in range(60)] + [(60, None), (61, "")]
    aliases = spark.createDataFrame([(name, f"T{n % 7}") for n, name in enumerate(names)], "alias_key string, target string")
    frame = spark.createDataFrame(texts, "id int, x string")
    found = {bound: sorted(map(tuple, mentions.mentions(frame, "id", "x", aliases, automaton_chars=bound).select("id", "start", "size", "alias_key", "target").collect()))
             for bound in (10 ** 6, 0)}
    expected, kept = [], []
    for n, text in texts:
        words = (text or "").lower().replace("!", "").replace("é", "e").split()
        own = [(n, i, len(a.split("-")), a, f"T{k % 7}") for k, a in enumerate(names) for i in range(len(words)) if words[i:i + len(a.split("-"))] == a.split("-")]
        expected += own
        kept += [m for m in own if not any(o[1] <= m[1] and o[1] + o[2] >= m[1] + m[2] and o[2] > m[2] for o in own)]
    assert found[10 ** 6] == found[0] == sorted(expected)
    table = mentions.mentions(frame, "id", "x", aliases)
    assert sorted(map(tuple, mentions.longest_mentions(table, "id").select("id", "start", "size", "alias_key", "target").collect())) == sorted(kept)
    outcome = {r["id"]: (r["target"], r["error"]) for r in mentions.required_mention(frame, table, "id").collect()}
    for n, _ in texts:
        targets = sorted({m[4] for m in kept if m[0] == n})
        assert outcome[n] == ((targets[0], None) if len(targets) == 1 else (None, "several names: " + ", ".join(targets) if targets else None))


def test_budget_and_pages(spark):
    df = spark.createDataFrame([("a", n, "x" * n) for n in range(1, 8)], "g string, n int, x string")
    kept = ranking.fit_byte_budget(df, ["g"], [F.asc("n")], F.col("x"), 10)
    assert sorted(r.n for r in kept.collect()) == [1, 2, 3, 4]
    page = ranking.Page([{}], 3, 1, 2).envelope()
    assert page["truncated"] and not page["has_more"]


def test_integrity(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    checks = integrity.report([integrity.orphan_count("o", child, "k", parent, "id"), integrity.duplicate_count("d", parent, ["id"])])
    assert {r.check_name: r.bad_rows for r in checks.collect()} == {"o": 1, "d": 0}
    with pytest.raises(ValueError, match="o: 1"):
        integrity.require_clean(checks)
    assert sorted(r.k for r in integrity.missing_numbers(parent.withColumnRenamed("id", "k"), "k", 1, 4).collect()) == [3, 4]


WIKI = """<!-- note -->{{#invoke:Infobox Pokémon|infobox
| nom = Bulbi
| talents = Engrais (talent){{!}}Engrais//[[Chlorophylle]]/[[talent caché]]
| ignoré = x
}}
{{Ruban Pokémon|{{Jeu|EV}}}}
== Description ==
Le '''Bulbi''' vit<ref name="a">note</ref> ici : [[Forêt (lieu)|forêt]], [[mer]].<br/>Fin
{{Mesures|taille = 0,7|poids = 6,9}}
=== Vide ===
==== Vide aussi ====
== Liste ==
* un
** deux
{{Statistiques|PV=45|vitesse=60}}
{{#invoke:Apprentissage|niveau
type=plante
1/Charge
}}
{{TableauEvolutionSimple|Niveau 16|Herbizarre}}
{{Article principal|[[Bulbi/Détails]]}}
{{Liste des cartes d'un Pokémon|Bulbi|première=Set}}
{{Inconnu|a}} {{Mesures|jamais fermé
[[Catégorie:Plante]]
en:Bulbi
Fichier:image.png
"""


def test_wiki_cleaning(spark):
    row = cleaning.clean_pages(spark.createDataFrame([("Bulbi", WIKI)], "title string, content string")).first()
    assert row.cleaned == """## Informations générales

- Nom : Bulbi
- Talents : Engrais, Chlorophylle (talent caché)

## Description
Le Bulbi vitnote ici : forêt, mer., Fin
- Taille : 0,7 m
- Poids : 6,9 kg
## Liste
- un
  - deux
### Statistiques

- PV : 45
- Vitesse : 60
- 1/Charge
- Niveau 16 → Herbizarre
Article principal : Bulbi/Détails
- Pokémon : Bulbi
- Première carte : Set
{{Inconnu|a}} {{Mesures|jamais fermé"""
    assert "Vide" not in row.cleaned and "{{Inconnu|a}} {{Mesures|jamais fermé" in row.cleaned and "Catégorie" not in row.cleaned


def test_quality_report(spark):
    body = "# Bulbi\n\n## Informations générales\n" + "texte " * 50
    pages = [("Bulbi", "x" * 300, body), ("", "x" * 900, "court"), ("Bulbi", "y" * 350, body + "[[x]]")]
    report = cleaning.quality_report(spark.createDataFrame(pages, "title string, content string, cleaned string"), "content", "cleaned", "title").collect()
    assert [r.status for r in report] == ["WARNING", "ERROR", "WARNING"]
    assert report[1].errors[0] == "Titre absent." and any("trop court" in e for e in report[1].errors)
    assert any("Markup résiduel : lien wiki" in w for w in report[2].warnings)


def popped(lists, budget, overhead):
    """Take rows off the largest list until the result fits."""
    size = lambda rows: len(json.dumps(rows, separators=(",", ":"), ensure_ascii=False).encode())
    lists = {name: list(rows) for name, rows in lists.items()}
    while any(lists.values()) and overhead + sum(map(size, lists.values())) > budget:
        lists[max(lists, key=lambda name: size(lists[name]) if lists[name] else 0)].pop()
    return lists if any(lists.values()) else None


def test_lists_share_a_budget(spark):
    rng = random.Random(3)
    names, groups, rows = ["results", "moves", "rows"], {}, []
    for g in range(40):
        groups[g] = {name: [{"k": k, "t": "é" * rng.randrange(12)} for k in range(rng.randrange(1, 9))] for name in rng.sample(names, rng.randrange(1, 4))}
        groups[g] = {name: groups[g][name] for name in names if name in groups[g]}
        rows += [(g, name, row["k"], row["t"]) for name, own in groups[g].items() for row in own]
    df = spark.createDataFrame(rows, "g int, name string, k int, t string")
    for budget in (40, 120, 400):
        kept, outcomes = ranking.fit_lists(df, ["g"], "name", names, [F.asc("k")], ranking.json_bytes("k", "t"), budget, 10)
        found = {(r.g, r.name, r.k) for r in kept.collect()}
        outcome = {r.g: r.outcome for r in outcomes.collect()}
        for g, lists in groups.items():
            left = popped(lists, budget, 10)
            assert {x for x in found if x[0] == g} == {(g, name, row["k"]) for name, own in (left or {}).items() for row in own}
            assert outcome[g] == ("too large" if left is None else "whole" if left == lists else "truncated")


def test_verbatim_holders_equal_plain_containment(spark):
    rng = random.Random(8)
    texts = [(n, "".join(rng.choice("abé ") for _ in range(rng.randrange(25)))) for n in range(80)] + [(80, None)]
    phrases = [(n, "".join(rng.choice("abé ") for _ in range(rng.randrange(4)))) for n in range(30)] + [(30, "ab"), (31, "ab"), (32, None)]
    frames = spark.createDataFrame(texts, "id int, x string"), spark.createDataFrame(phrases, "p long, t string")
    for bound in (1000, 7):
        found = mentions.verbatim_holders(frames[0], "id", "x", frames[1], "p", "t", automaton_chars=bound).collect()
        assert sorted((r.p, r.id) for r in found) == sorted((p, n) for p, t in phrases for n, x in texts if t and x and t in x)
        counts = {r.id: r.held for r in mentions.held_counts(frames[0], "x", frames[1], "t", "held", automaton_chars=bound).collect()}
        assert counts == {n: len({t for _, t in phrases if t and x and t in x}) for n, x in texts}


def test_rows_are_dealt_by_their_number(spark):
    rows = session.dealt(spark.range(10_000).withColumn("k", F.col("id") % 5000), "k", rows_per_task=500)
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert rows.rdd.getNumPartitions() == 20 and max(r["count"] for r in sizes) < 800
    assert rows.select("k").distinct().count() == 5000


def test_mentions_are_dealt_by_the_number_of_texts(spark, monkeypatch):
    monkeypatch.setattr(mentions, "TEXTS_PER_TASK", 10)
    texts = spark.range(200).select(F.col("id"), F.lit("alpha beta gamma").alias("text"))
    aliases = spark.createDataFrame([("alpha-beta", 1), ("beta", 2), ("gamma", 3)], "alias_key string, target int")
    found = mentions.dealt_mentions(texts, mentions.mentions(texts, "id", "text", aliases), "id")
    assert found.rdd.getNumPartitions() == 20
    assert sorted(r.target for r in mentions.longest_mentions(found, "id").where("id = 7").collect()) == [1, 3]
