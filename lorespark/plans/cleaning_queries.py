"""Registered queries of page cleaning over pages and over wiki pages written from table rows, with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.operators import cleaning
from lorespark.session import table, wide_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


# ---- HTML pages ----------------------------------------------------------------


@query("markup_cleaning", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script\s*>', '', 'gis'), '<style\b[^>]*>.*?</style\s*>', '', 'gis'), '<!--.*?-->', '', 'gs') AS k FROM pages),
b AS (SELECT page_id, regexp_replace(k, '<nav\b[^>]*>.*?</nav\s*>', '', 'gis') AS k FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(k, '<h1[^>]*>', chr(10) || '# ', 'gi'), '<li[^>]*>', chr(10) || '- ', 'gi') AS k FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(k, '<br\s*/?>|</p>|</h1>|</li>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS k FROM c),
e AS (SELECT page_id, regexp_replace(regexp_replace(k, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS k FROM d),
f AS (SELECT page_id, trim(regexp_replace(k, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS k FROM e)
SELECT page_id, md5(k) AS cleaned_hash, length(k) AS cleaned_size FROM f""")
def markup_cleaning(spark, sf):
    rows = wide_table(spark, sf, "pages").select("page_id", cleaning.html_to_markdown(F.col("html")).alias("k"))
    return rows.select("page_id", F.md5("k").alias("cleaned_hash"), F.length("k").cast("long").alias("cleaned_size"))


@query("doc_quality_rules", r"""
WITH p AS (SELECT page_id, '# ' || regexp_extract(html, '<title>([^<]*)', 1) || chr(10) || chr(10) || html AS cleaned, html AS raw, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
r AS (SELECT page_id, CASE WHEN trim(title) = '' THEN 1 ELSE 0 END + CASE WHEN length(cleaned) < 200 THEN 1 ELSE 0 END
    + CASE WHEN NOT regexp_matches(cleaned, '(?m)^#{2,6}\s+\S') THEN 1 ELSE 0 END AS errors,
    CASE WHEN length(cleaned) / length(raw) > 1.2 THEN 1 ELSE 0 END AS too_long FROM p)
SELECT page_id, CAST(errors AS BIGINT) AS errors, CAST(too_long AS BIGINT) AS too_long, CASE WHEN errors > 0 THEN 'ERROR' ELSE 'WARNING' END AS status FROM r""")
def doc_quality_rules(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    pages = wide_table(spark, sf, "pages").withColumn("title", title).withColumn("cleaned", F.concat(F.lit("# "), "title", F.lit("\n\n"), "html"))
    report = cleaning.quality_report(pages, "html", "cleaned", "title")
    too_long = F.size(F.filter("warnings", lambda w: w.startswith("Document nettoyé plus long")))
    return report.select("page_id", F.size("errors").cast("long").alias("errors"), too_long.cast("long").alias("too_long"), "status")


@query("wiki_cleaning_templates", """
SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || chr(10) || '### Statistiques' || chr(10) || chr(10) || '- PV : ' || o_custkey || chr(10)
    || '- Vitesse : ' || o_orderpriority || chr(10) || chr(10) || '- ' || o_orderstatus || chr(10) || '  - ' || o_custkey || chr(10) || 'lien ' || o_orderpriority AS cleaned
FROM orders""")
def wiki_cleaning_templates(spark, sf):
    """Each order written as a wiki page with nested templates, lists, links and empty sections."""
    orders = wide_table(spark, sf, "orders").withColumn("title", F.concat(F.lit("Order "), F.col("o_orderkey")))
    page = F.concat(
        F.lit("# {{PAGENAME}}<!-- x -->\n\n=== Vide ===\n\n{{Ruban Pokémon|{{Jeu|EV}}}}\n{{Statistiques|PV="), "o_custkey",
        F.lit("|vitesse="), "o_orderpriority", F.lit("|x={{ps|a}}}}\n\n* '''"), "o_orderstatus", F.lit("'''\n** "), "o_custkey",
        F.lit("<ref name=\"a\"></ref>\nlien [[Page|"), "o_orderpriority", F.lit("]]\n=== Fin ===\nFichier:x.png\n"))
    cleaned = cleaning.clean_pages(orders.withColumn("content", page))
    return cleaned.select("o_orderkey", "cleaned")


@query("national_number_extract", """
SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 1025 THEN CAST(p_partkey AS BIGINT) WHEN p_size BETWEEN 1 AND 1025 THEN CAST(p_size AS BIGINT) END AS number FROM part""")
def national_number_extract(spark, sf):
    text = F.concat(F.lit("{{Infobox\n| numéro = 00"), "p_partkey", F.lit(" \n| nom = x\n| ndex = "), "p_size", F.lit("\n}}"))
    short = F.when(F.length(F.col("p_partkey").cast("string")) <= 4, text).otherwise(F.concat(F.lit("| ndex = "), "p_size"))
    return table(spark, sf, "part").select("p_partkey", cleaning.national_number(short).cast("long").alias("number"))


# ---- one query per template: pages written from the rows of a table ----------------


def page(pattern: str) -> Column:
    """Text with ``<column>`` replaced by the columns of a row."""
    pieces = re.split(r"<(\w+)>", pattern)
    return F.concat(*[F.col(piece).cast("string") if n % 2 else F.lit(piece) for n, piece in enumerate(pieces)])


def page_sql(pattern: str) -> str:
    pieces = re.split(r"<(\w+)>", pattern)
    literal = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(piece if n % 2 else literal(piece) for n, piece in enumerate(pieces))


def template_query(name: str, written: str, expected: str, doc: str) -> None:
    def cleaned(spark, sf):
        parts = wide_table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), page(written).alias("content"))
        return cleaning.clean_pages(parts).select("p_partkey", "cleaned")

    cleaned.__name__, cleaned.__doc__ = name, doc
    query(name, f"SELECT p_partkey, {page_sql(expected)} AS cleaned FROM part")(cleaned)


template_query(
    "clean_infobox",
    "{{#invoke:Infobox Pokémon|infobox\n| nom = '''<p_name>'''\n| type1 = [[<p_brand> (type)|<p_brand>]]\n| talents = <p_brand> (talent){{!}}<p_brand>//[[N<p_size>]]/[[talent caché]]\n"
    "| taille = {{Jeu|<p_size>}}\n| poids =\n| ignoré = x\n}}",
    "## Informations générales\n\n- Nom : <p_name>\n- Type 1 : <p_brand>\n- Talents : <p_brand>, N<p_size> (talent caché)\n- Taille : <p_size>",
    "Infobox fields, abilities by links, and a value template inside a field.")
template_query(
    "clean_measures", "{{Mesures|taille = <p_size>,5|poids=''<p_partkey>''}}\n{{Mesures|largeur=3}}\n{{Mesures|taille=1",
    "- Taille : <p_size>,5 m\n- Poids : <p_partkey> kg\n{{Mesures|largeur=3}}\n{{Mesures|taille=1",
    "Measures; one without known fields and one that never closes stay.")
template_query(
    "clean_nested_statistics", "{{Mesures|x={{Statistiques|PV=<p_size>|Vitesse= <p_partkey> |y={{Statistiques|PV=1}}}}}}\n{{Inconnu|{{Statistiques|special=[[<p_brand>]]}}}}",
    "{{Mesures|x=### Statistiques\n\n- PV : <p_size>\n- Vitesse : <p_partkey>}}\n{{Inconnu|### Statistiques\n\n- Spécial : <p_brand>}}",
    "Statistics inside a template that stays untouched, and inside each other.")
template_query(
    "clean_learning", "{{#invoke:Apprentissage|niveau\n|type=plante\n|<p_size>/[[<p_name>]]\n\n||<p_partkey>/{{PMS|<p_brand>}}\nsans barre\nGénération=3/4\n}}",
    "- <p_size>/<p_name>\n- <p_partkey>/<p_brand>", "Learning rows without technical fields.")
template_query(
    "clean_evolutions", "{{TableauEvolutionHaut|a}}{{TableauEvolutionSimple|Niveau <p_size>|[[<p_name>]]}}\n{{TableauEvolutionConditionBranche/2|[[x|<p_brand>]]}}\n"
    "{{TableauEvolutionBranche/1|<p_name>|x}}\n{{TableauEvolutionBranche/x|a}}{{TableauEvolutionBas}}",
    "- Niveau <p_size> → <p_name>\n- Condition : <p_brand>\n- Évolution : <p_name>\n{{TableauEvolutionBranche/x|a}}", "Evolution tables and their branches.")
template_query(
    "clean_dynamic", "a{{#invoke:Localisations|{{Statistiques|PV=<p_size>}}}}<p_name>{{#invoke:Sensibilités|{{Jeu|EV}}\n}}b", "a<p_name>b",
    "Templates that a module fills when the page is shown go, with whatever they hold.")
template_query(
    "clean_main_article", "{{Article principal|[[<p_name>/Détails|<p_name>]]}}\n{{Article principal}}", "Article principal : <p_name>\n{{Article principal}}", "Main article links.")
template_query(
    "clean_card_list", "{{Liste des cartes d'un Pokémon|nom=<p_name>{{Ruban Pokémon}}|Première=[[<p_brand>]]}}\n{{Liste des cartes d'un Pokémon| |<p_name>|premiere=\n<p_size>}}\n{{Liste des cartes d'un Pokémon|x=1}}",
    "- Pokémon : <p_name>\n- Première carte : <p_brand>\n- Pokémon : <p_name>\n- Première carte : <p_size>\n{{Liste des cartes d'un Pokémon|x=1}}", "Card lists, one with a ribbon in a value.")
template_query(
    "clean_visual", "{{Ruban Pokémon|a={{Générations|{{Bandeau Pokédex}}}}}}<p_name>\n{{Renvoi imagerie}}{{Pokémon de départ|<p_size>}}fin", "<p_name>\nfin", "Presentation templates inside each other.")
template_query(
    "clean_value_templates", "{{Jeu| <p_name> |y}}, {{ps|Chen}}, {{PCap|<p_brand>}}, {{PMS}}, {{ PMS|<p_size>}}, {{PAGENAME}}{{#lst:A/Imagerie|z}}{{BR}}x<gallery mode=\"a\">\nFichier:<p_size>.png\n</gallery>",
    "<p_name>, Chen, <p_brand>, PMS, <p_size>, <p_name>{{BR}}x", "Templates that stand for their first value, the page name, galleries.")


@query("cleaning_batch_summary", r"""
WITH p AS (SELECT regexp_extract(html, '<title>([^<]*)', 1) AS title, html AS raw, '# ' || regexp_extract(html, '<title>([^<]*)', 1) || chr(10) || chr(10) || html AS cleaned FROM pages),
r AS (SELECT length(raw) AS raw_size, length(cleaned) AS size, trim(title) = '' OR length(cleaned) < 200 OR NOT regexp_matches(cleaned, '(?m)^#{2,6}\s+\S') AS bad FROM p)
SELECT CASE WHEN bad THEN 'ERROR' ELSE 'WARNING' END AS status, count(*) AS pages, sum(raw_size)::BIGINT AS raw_size, sum(size)::BIGINT AS cleaned_size, round(avg(size / raw_size), 9) AS mean_ratio FROM r GROUP BY 1""")
def cleaning_batch_summary(spark, sf):
    """Totals of a cleaning run by status."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    pages = wide_table(spark, sf, "pages").withColumn("title", title).withColumn("cleaned", F.concat(F.lit("# "), "title", F.lit("\n\n"), "html"))
    return cleaning.batch_summary(cleaning.quality_report(pages, "html", "cleaned", "title")).withColumn("mean_ratio", F.round("mean_ratio", 9))
