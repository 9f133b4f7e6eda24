"""Registered queries of fact sheets, evolutions and question understanding, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions.text import name_key_column
from lorespark.operators import history, latest
from lorespark.operators.matchups import type_matchups
from lorespark.operators.questions import explicit_constraints, fast_plans
from lorespark.plans import retrieval
from lorespark.plans.catalogue import Catalogue
from lorespark.plans.evolutions import evolution_rules
from lorespark.plans.sheet import measure_texts, readable_text, sheet_facts
from lorespark.plans.text_queries import key_sql
from lorespark.plans.vocabulary import ABILITY_IMMUNITIES
from lorespark.plans.warehouse import ROLE_SQL, warehouse_catalogue
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


@query("measure_texts", """
SELECT p_partkey AS entity_id, CASE WHEN p_size % 50 <> 0 THEN replace(printf('%.1f m', (p_size % 50) / 10.0), '.', ',') END AS height,
    replace(printf('%.1f kg', CAST(floor(p_retailprice) AS INT) / 10.0), '.', ',') AS weight, (p_size * 5) || ' sur 255' AS capture_rate FROM part""")
def measure_texts_query(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    return measure_texts(cat["entity"], cat["species"])


@query("sheet_fact_lists", f"""WITH {ROLE_SQL} SELECT CAST(source_row AS BIGINT) AS source_row, regexp_replace('Talent 1=' || p_brand
    || CASE WHEN p_size > 25 THEN '|Talent 2=' || p_type ELSE '' END || '|Stade d''évolution=' || stade_d_evolution || '|Sous-groupe=' || sous_groupe, '#(\\d+)', 'rang \\1', 'g') AS facts
FROM sheet JOIN part ON p_partkey = source_row""")
def sheet_fact_lists(spark, sf):
    facts = sheet_facts(warehouse_catalogue(spark, sf)["sheet"])
    text = F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return facts.select(F.col("source_row").cast("long").alias("source_row"), text.alias("facts"))


@query("readable_sheet_text", """
SELECT p_partkey, 'Parmi tous les Pokémon — PV : ' || CASE WHEN p_size = 1 THEN 'la' ELSE p_size || 'e' END || ' plus haute (' || p_partkey || ') ; Plus haute valeur de la génération '
    || (p_size % 9) || ' ; Parmi les Méga-Évolutions — Vitesse : ' || CASE WHEN p_size = 1 THEN 'la' ELSE p_size || 'e' END || ' plus basse (3) (tous les Pokémon)' AS text FROM part""")
def readable_sheet_text(spark, sf):
    part = table(spark, sf, "part")
    cell = F.concat(
        F.lit("Top 10 global — PV #"), "p_size", F.lit(" ("), "p_partkey", F.lit(") ; Records G"), F.col("p_size") % 9,
        F.lit(" ; Bottom 10 parmi les Méga-Évolutions — Vitesse #"), "p_size", F.lit(" (3) (global)"))
    return part.select("p_partkey", readable_text(cell).alias("text"))


@query("type_matchup_texts", f"""WITH {ROLE_SQL}, chart AS (SELECT a.n_name AS attacker, a.n_nationkey AS id, t.n_name AS target,
    CASE (a.n_nationkey * 7 + t.n_nationkey * 3) % 5 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 200 ELSE 100 END AS f FROM nation a, nation t),
m AS (SELECT e.entity_id, c1.attacker, c1.id, (c1.f * coalesce(c2.f, 100)) // 100 AS f FROM entry e JOIN chart c1 ON c1.target = e.type_1_fr
    LEFT JOIN chart c2 ON c2.target = e.type_2_fr AND c2.attacker = c1.attacker),
x AS (SELECT *, attacker || CASE f WHEN 400 THEN ' (×4)' WHEN 200 THEN ' (×2)' WHEN 50 THEN ' (×½)' WHEN 25 THEN ' (×¼)' ELSE '' END AS t FROM m WHERE f <> 100)
SELECT CAST(entity_id AS BIGINT) AS entity_id, coalesce(string_agg(t, ', ' ORDER BY f DESC, id) FILTER (f > 100), 'aucune') AS weaknesses,
    string_agg(t, ', ' ORDER BY f DESC, id) FILTER (f > 0 AND f < 100) AS resistances, string_agg(t, ', ' ORDER BY id) FILTER (f = 0) AS immunities FROM x GROUP BY entity_id""")
def type_matchup_texts(spark, sf):
    cat, nation = warehouse_catalogue(spark, sf), table(spark, sf, "nation")
    ids = nation.agg(F.collect_list("n_nationkey").alias("ids"))
    pairs = nation.select(F.col("n_nationkey").alias("damage_type_id"), F.explode(ids.scalar()).alias("target_type_id"))
    code = (F.col("damage_type_id") * 7 + F.col("target_type_id") * 3) % 5
    efficacy = pairs.withColumn("damage_factor", F.when(code == 0, 0).when(code == 1, 50).when(code == 2, 200).otherwise(100))
    entries = cat["entry"].select(
        F.col("entity_id").cast("long").alias("entity_id"), F.col("type_1_fr").alias("type_1"), F.col("type_2_fr").alias("type_2"),
        F.array().cast("array<string>").alias("abilities"))
    return type_matchups(entries, efficacy, nation.select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name")), "entity_id")


# Five attacking types that abilities cancel stand for the first nations; entries hold none to three abilities, some blank.
_NAMED_TYPES = ["Sol", "Eau", "Électrik", "Feu", "Plante"]
_HELD = [[], ["Lévitation"], ["Lévitation", "Torche"], ["Absorbe-Eau", "Lavabo", "Cran"], ["Herbivore", None, ""], ["Cran"]]
_HELD_SQL = "[" + ", ".join("[" + ", ".join("NULL" if a is None else f"'{a}'" for a in held) + "]::VARCHAR[]" for held in _HELD) + "]"
_NAME_SQL = lambda column: "CASE " + column + " " + " ".join(f"WHEN 'NATION_{k}' THEN '{name}'" for k, name in enumerate(_NAMED_TYPES)) + f" ELSE {column} END"
_ABILITY_SQL = "[" + ", ".join(f"'{ability}/{immune}'" for ability, immune in ABILITY_IMMUNITIES.items()) + "]"


@query("type_matchup_abilities", f"""WITH {ROLE_SQL},
chart AS (SELECT {_NAME_SQL('a.n_name')} AS attacker, a.n_nationkey AS id, t.n_name AS target,
    CASE (a.n_nationkey * 7 + t.n_nationkey * 3) % 5 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 200 ELSE 100 END AS f FROM nation a, nation t),
m AS (SELECT e.entity_id, c1.attacker, c1.id, (c1.f * coalesce(c2.f, 100)) // 100 AS f, list_filter({_HELD_SQL}[1 + e.entity_id % 6], lambda a: a <> '') AS held
    FROM entry e JOIN chart c1 ON c1.target = e.type_1_fr LEFT JOIN chart c2 ON c2.target = e.type_2_fr AND c2.attacker = c1.attacker),
g AS (SELECT *, list_filter(held, lambda a: list_contains({_ABILITY_SQL}, a || '/' || attacker)) AS granting FROM m),
x AS (SELECT *, CASE f WHEN 400 THEN '×4' WHEN 200 THEN '×2' WHEN 50 THEN '×½' WHEN 25 THEN '×¼' END AS times, array_to_string(granting, ' ou ') AS by_,
    CASE WHEN f > 100 THEN 'w' WHEN f > 0 THEN 'r' ELSE 'i' END AS plain FROM g WHERE f <> 100 OR len(granting) > 0),
y AS (SELECT entity_id, id, f, CASE WHEN len(granting) = 0 OR f = 0 THEN plain WHEN len(granting) = len(held) OR f = 100 THEN 'i' ELSE plain END AS c,
    attacker || CASE WHEN len(granting) = 0 OR f = 0 THEN CASE WHEN f = 0 THEN '' ELSE ' (' || times || ')' END WHEN len(granting) = len(held) THEN ' (talent ' || by_ || ')'
        WHEN f = 100 THEN ' (seulement s''il a le talent ' || by_ || ')' ELSE ' (' || times || ' ; immunisé seulement s''il a le talent ' || by_ || ')' END AS t FROM x)
SELECT CAST(entity_id AS BIGINT) AS entity_id, coalesce(string_agg(t, ', ' ORDER BY f DESC, id) FILTER (c = 'w'), 'aucune') AS weaknesses,
    string_agg(t, ', ' ORDER BY f DESC, id) FILTER (c = 'r') AS resistances, string_agg(t, ', ' ORDER BY f DESC, id) FILTER (c = 'i') AS immunities FROM y GROUP BY entity_id""")
def type_matchup_abilities(spark, sf):
    """Type chart with the abilities of each entry."""
    cat, nation = warehouse_catalogue(spark, sf), table(spark, sf, "nation")
    renamed = F.create_map(*[F.lit(x) for k, name in enumerate(_NAMED_TYPES) for x in (f"NATION_{k}", name)])
    name = lambda column: F.coalesce(F.element_at(renamed, F.col(column)), F.col(column))
    # A chart of all pairs of types; their number is that of the nations.
    pairs = nation.select(F.col("n_nationkey").alias("damage_type_id")).crossJoin(nation.select(F.col("n_nationkey").alias("target_type_id")))
    code = (F.col("damage_type_id") * 7 + F.col("target_type_id") * 3) % 5
    efficacy = pairs.withColumn("damage_factor", F.when(code == 0, 0).when(code == 1, 50).when(code == 2, 200).otherwise(100))
    held = F.array(*[F.array(*map(F.lit, abilities)).cast("array<string>") for abilities in _HELD])
    entries = cat["entry"].select(F.col("entity_id").cast("long").alias("entity_id"), name("type_1_fr").alias("type_1"), name("type_2_fr").alias("type_2"),
                                  F.get(held, (F.col("entity_id") % 6).cast("int")).alias("abilities"))
    return type_matchups(entries, efficacy, nation.select(F.col("n_nationkey").alias("type_id"), name("n_name").alias("name")), "entity_id")


@query("absence_texts", """
WITH p AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), y AS (SELECT DISTINCT y FROM p WHERE y <> 1998),
f AS (SELECT o_custkey, min(y) AS first_year FROM p WHERE y <> 1998 GROUP BY o_custkey),
m AS (SELECT f.o_custkey, string_agg('année ' || y.y, ' ; ' ORDER BY y.y) AS t FROM f JOIN y ON y.y > f.first_year
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.o_custkey = f.o_custkey AND p.y = y.y) GROUP BY f.o_custkey)
SELECT f.o_custkey AS entity_id, coalesce(t, 'aucun') AS text FROM f LEFT JOIN m USING (o_custkey)""")
def absence_texts(spark, sf):
    learn = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("game_id"))
    games = learn.select("game_id").distinct().filter("game_id <> 1998").withColumn("order", F.col("game_id")).withColumn(
        "label", F.concat(F.lit("année "), "game_id"))
    return history.absences(learn, games)


@query("held_item_texts", """
WITH r AS (SELECT l_partkey, l_suppkey, CAST(min(l_quantity) AS INT) AS lo, CAST(max(l_quantity) AS INT) AS hi, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b
    FROM lineitem GROUP BY 1, 2)
SELECT l_partkey AS entity_id, string_agg(s_name || ' (' || CASE WHEN lo = hi THEN lo || ' %' ELSE lo || ' à ' || hi || ' %' END || ', '
    || CASE WHEN a = b THEN 'G' || a ELSE 'G' || a || '–G' || b END || ')', ', ' ORDER BY hi DESC, s_name) AS text FROM r JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey""")
def held_item_texts(spark, sf):
    line = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("item_id"), F.year("l_shipdate").alias("version_id"), F.col("l_quantity").cast("int").alias("rarity"))
    versions = line.select("version_id").distinct().withColumn("game_id", F.col("version_id"))
    games = versions.select("game_id", F.col("game_id").alias("generation_id"))
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"))
    return history.held_items(line, versions, games, names)


@query("evolution_rules", """
SELECT p.p_partkey AS evolution_id, t.p_partkey - 1 AS source_species_id, replace(s.p_name, ' ', '-') || '-' || s.p_partkey AS source_name,
    replace(t.p_name, ' ', '-') || '-' || t.p_partkey AS target_name, CASE WHEN p.p_size % 2 = 0 THEN 'level-up' ELSE 'trade' END AS trigger,
    CASE WHEN p.p_size % 2 <> 0 THEN 'échange' WHEN p.p_size % 10 = 0 THEN 'gain d''un niveau, quel que soit le niveau' ELSE 'montée de niveau' END AS trigger_fr,
    CASE WHEN p.p_size % 10 <> 0 THEN CAST(p.p_size % 10 AS VARCHAR) END AS minimum_level, '0' AS relative_physical_stats
FROM part p JOIN part t ON t.p_partkey = p.p_partkey LEFT JOIN part s ON s.p_partkey = t.p_partkey - 1""")
def evolution_rules_query(spark, sf):
    cat, part = warehouse_catalogue(spark, sf), table(spark, sf, "part")
    rules = part.selectExpr(
        "p_partkey AS evolution_id", "p_partkey AS evolved_species_id", "p_size % 2 AS evolution_trigger_id", "CAST(NULL AS INT) AS game_id",
        "CAST(NULL AS BIGINT) AS required_form_id", "CAST(NULL AS BIGINT) AS evolved_form_id", "p_size % 10 AS minimum_level", "0 AS relative_physical_stats")
    triggers = part.selectExpr("p_size % 2 AS evolution_trigger_id").distinct().withColumn(
        "identifier", F.when(F.col("evolution_trigger_id") == 0, "level-up").otherwise("trade"))
    roles = {role: cat[role] for role in ("species", "form", "game")}
    rows = evolution_rules(Catalogue({**roles, "evolution": rules, "trigger": triggers}))
    return rows.select(
        "evolution_id", "source_species_id", F.col("from.species.identifier").alias("source_name"), F.col("to.species.identifier").alias("target_name"),
        "trigger", "trigger_fr", F.try_element_at("conditions", F.lit("minimum_level")).alias("minimum_level"),
        F.try_element_at("conditions", F.lit("relative_physical_stats")).alias("relative_physical_stats"))


@query("ambiguous_names", f"""
SELECT {key_sql('p_name')} AS alias_key, count(DISTINCT p_partkey) AS entities, min(p_partkey) AS first_entity FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""")
def ambiguous_names(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.array(
        name_key_column(F.col("p_name")), name_key_column(F.upper("p_name"))))).alias("alias_key"))
    found = part.groupBy("alias_key").agg(F.countDistinct("p_partkey").alias("entities"), F.min("p_partkey").alias("first_entity"))
    return found.filter("entities > 1")


@query("default_entry_names", f"""WITH {ROLE_SQL} SELECT CAST(s.generation_id AS BIGINT) AS generation, count(*) AS entries, count(*) FILTER (f.is_default = 1) AS default_forms,
    count(*) FILTER (f.short_form IS NOT NULL) AS named_forms FROM species s JOIN form f ON f.form_id = s.species_id GROUP BY 1""")
def default_entry_names(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    rows = cat["species"].select("species_id", "generation_id").join(
        cat["form"].select(F.col("form_id").alias("species_id"), "is_default", "form_identifier"), "species_id")
    return rows.groupBy(F.col("generation_id").cast("long").alias("generation")).agg(
        F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("is_default") == 1, 1)).alias("default_forms"), F.count("form_identifier").alias("named_forms"))


# ---- questions -----------------------------------------------------------------


@query("question_level_bounds", """
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN low END AS min_level, CASE WHEN ok THEN high END AS max_level, CASE WHEN NOT ok THEN 'level: impossible interval' END AS error
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) + 1 AS low, CAST(floor(l_quantity) AS BIGINT) + l_linenumber - 1 AS high,
    l_linenumber > 1 AS ok FROM lineitem)""")
def question_level_bounds(spark, sf):
    level = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("Que peut-il apprendre après le niveau "), level, F.lit(" et avant le niveau "), level + F.col("l_linenumber"), F.lit(" ?"))
    found = explicit_constraints(wide_table(spark, sf, "lineitem").withColumn("question", text))
    return found.select(
        "l_orderkey", "l_linenumber", F.col("level.low").cast("long").alias("min_level"), F.col("level.high").cast("long").alias("max_level"),
        F.col("level.error").alias("error"))


@query("question_search_constraints", """
SELECT c_custkey, CAST(c_nationkey % 9 + 1 AS BIGINT) AS generation, CASE c_nationkey % 3 WHEN 0 THEN 'fire' WHEN 1 THEN 'water' ELSE 'fairy' END AS type,
    CASE WHEN c_nationkey % 2 = 0 THEN true END AS legendary, CAST(c_custkey % 100 + 1 AS BIGINT) AS power FROM customer""")
def question_search_constraints(spark, sf):
    kind = F.element_at(F.array(F.lit("Feu"), F.lit("Eau"), F.lit("Fée")), F.col("c_nationkey") % 3 + 1)
    text = F.concat(
        F.lit("Quels Pokémon "), F.when(F.col("c_nationkey") % 2 == 0, "légendaires ").otherwise(""), F.lit("de type "), kind, F.lit(" de la génération "),
        F.col("c_nationkey") % 9 + 1, F.lit(" ont une capacité de puissance d'au moins "), F.col("c_custkey") % 100 + 1, F.lit(" ?"))
    found = explicit_constraints(wide_table(spark, sf, "customer").withColumn("question", text))
    return found.select(
        "c_custkey", F.col("generation.value").cast("long").alias("generation"), F.get("types.types", F.lit(0)).alias("type"),
        F.col("classification.legendary").alias("legendary"), F.col("power.low").cast("long").alias("power"))


@query("question_rankings", """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'defense' ELSE 'weight' END AS sort_by,
    CASE p_size % 3 WHEN 0 THEN 'asc' ELSE 'desc' END AS sort_order, p_size % 2 = 0 AS best_only, CAST(CASE WHEN p_size % 2 = 0 THEN 30 ELSE p_size END AS BIGINT) AS result_limit FROM part""")
def question_rankings(spark, sf):
    wording = F.element_at(F.array(
        F.lit("les Pokémon les plus lents"), F.lit("les Pokémon avec la meilleure Défense"), F.lit("les Pokémon plus lourds")), F.col("p_size") % 3 + 1)
    text = F.concat(F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("Top "), "p_size", F.lit(" : "))).otherwise(""), wording)
    found = explicit_constraints(wide_table(spark, sf, "part").withColumn("question", text))
    return found.select(
        "p_partkey", "ranking.sort_by", "ranking.sort_order", "ranking.best_only", F.col("ranking.limit").cast("long").alias("result_limit"))


@query("question_cues", f"""
WITH t AS (SELECT conv_id, turn, {key_sql('text')} AS k FROM conversations)
SELECT conv_id, turn, regexp_matches(k, '(?:^|-)(?:types?|numeros?|generations?|evolu[a-z]*|capacites?|attaques?|statistiques?|stats?|talents?|ct|cs|niveaux?|pv|vitesse|defense)(?:-|$)') AS structured,
    regexp_matches(k, '(?:^|-)(?:crai(?:nt|gn[a-z]*)|faibles?-(?:a|au|aux|contre|face)|faiblesses?|resist[a-z]*|immunis[a-z]*|immunites?|(?:in)?sensibles?|vulnerab[a-z]*)(?:-|$)') AS matchup FROM t""")
def question_cues(spark, sf):
    found = explicit_constraints(wide_table(spark, sf, "conversations"), "text")
    return found.select("conv_id", "turn", F.col("has_structured_request").alias("structured"), F.col("is_matchup").alias("matchup"))


@query("question_plans", """
SELECT s_suppkey AS question_id, CASE s_suppkey % 3 WHEN 0 THEN 'get_evolutions' WHEN 1 THEN 'get_level_up_moves' ELSE 'get_machine_moves' END AS operation,
    s_name AS entity, CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_nationkey + 1 AS BIGINT) END AS min_level, CASE WHEN s_suppkey % 3 = 2 THEN 'sun-moon' END AS version_group FROM supplier""")
def question_plans(spark, sf):
    supplier = table(spark, sf, "supplier")
    code = F.col("s_suppkey") % 3
    text = F.when(code == 0, F.concat(F.lit("Comment évolue "), "s_name", F.lit(" ?"))).when(
        code == 1, F.concat(F.lit("Que sait faire "), "s_name", F.lit(" après le niveau "), "s_nationkey", F.lit(" ?"))).otherwise(
        F.concat(F.lit("Quelles CT pour "), "s_name", F.lit(" dans Soleil et Lune ?")))
    names = supplier.select(name_key_column(F.col("s_name")).alias("alias_key"), F.col("s_name").alias("target"))
    found = fast_plans(supplier.select(F.col("s_suppkey").alias("question_id"), text.alias("question")), names, names.filter("false"), names)
    return found.select("question_id", "operation", "entity", F.col("min_level").cast("long").alias("min_level"), "version_group")


@query("hybrid_retrieval")
def hybrid_retrieval(spark, sf):
    """The whole pipeline: documents with the vector of their number, benchmark texts as questions."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vector"))
    slots = vectors.agg(F.max("slot") + 1).scalar()
    chunks = wide_table(spark, sf, "documents").withColumn("slot", F.col("doc_id") % slots).join(vectors, "slot", "left").select(
        "doc_id", F.col("lang").alias("scope"), F.col("source").alias("source_file"), F.col("lang").alias("section_path"),
        F.col("doc_id").cast("int").alias("chunk_number"), F.col("doc_id").cast("int").alias("section_chunk_number"), "text", "vector")
    questions = table(spark, sf, "benchmark").withColumn("slot", F.col("item_id") % slots).join(vectors, "slot", "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "EN").alias("scope"), "vector")
    return retrieval.retrieve(chunks, questions).select("query_id", "doc_id", "reranker_rank", F.round("reranker_score", 6).alias("score"))
