"""Registered queries of the catalogue operators over the sales warehouse, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import name_key_column
from lorespark.operators import evaluation, history, integrity, labels, latest, predicates, ranking, traces
from lorespark.operators.distributions import linear_percentiles, nearest_rank_percentiles
from lorespark.operators.matchups import type_factors
from lorespark.plans import moves
from lorespark.plans.catalogue import Catalogue
from lorespark.plans.search import missing_default_forms
from lorespark.plans.warehouse import ROLE_SQL, catalogue_search, warehouse_catalogue
from lorespark.session import dealt, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


# ---- searches --------------------------------------------------------------

SEARCH_COLUMNS = """CAST(f.form_id AS BIGINT) AS form_id, e.name_fr, CAST(e.entity_id AS BIGINT) AS entity_id,
    e.type_1_fr, e.type_2_fr, CAST(s.generation_id AS BIGINT) AS generation"""
SEARCH_FROM = "FROM entry e JOIN species s ON s.species_id = e.entity_id JOIN form f ON f.form_id = e.entity_id"


def _search_output(df: DataFrame, *extra) -> DataFrame:
    return df.select(
        F.col("form_id").cast("long").alias("form_id"), "name_fr", F.col("entity_id").cast("long").alias("entity_id"),
        "type_1_fr", "type_2_fr", F.col("generation").cast("long").alias("generation"), *extra)


@query("filtered_search_page", """
SELECT c_custkey, c_name, c_acctbal, n_name, count(*) OVER () AS total_count
FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_acctbal <= 8000
ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 60""")
def filtered_search_page(spark, sf):
    rows = table(spark, sf, "customer").filter(
        (F.col("c_mktsegment") == "BUILDING") & predicates.within(F.col("c_acctbal"), 1000, 8000)
    ).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    matching = rows.select("c_custkey", "c_name", "c_acctbal", "n_name")
    page = ranking.page_rows(matching, [F.desc("c_acctbal"), F.asc("c_custkey")], 30, 60)
    return ranking.with_total(page, matching)


for _match, _condition in {
    "all": "'NATION_3' IN (e.type_1_fr, e.type_2_fr) AND 'NATION_7' IN (e.type_1_fr, e.type_2_fr)",
    "any": "('NATION_3' IN (e.type_1_fr, e.type_2_fr) OR 'NATION_7' IN (e.type_1_fr, e.type_2_fr))",
    "exact": """'NATION_3' IN (e.type_1_fr, e.type_2_fr) AND (CASE WHEN e.type_1_fr IS NULL THEN 0 ELSE 1 END
        + CASE WHEN e.type_2_fr IS NULL THEN 0 ELSE 1 END) = 1""",
}.items():
    def _run(spark, sf, match=_match):
        wanted = ["nation 3"] if match == "exact" else ["nation 3", "NATION_7"]
        return _search_output(catalogue_search(warehouse_catalogue(spark, sf), types=wanted, type_match=match))
    query(f"search_types_{_match}", f"WITH {ROLE_SQL} SELECT {SEARCH_COLUMNS} {SEARCH_FROM} "
          f"WHERE f.is_default = 1 AND {_condition}")(_run)


@query("search_flags_generation", f"""WITH {ROLE_SQL} SELECT {SEARCH_COLUMNS} {SEARCH_FROM}
WHERE f.is_default = 1 AND s.generation_id = 4 AND s.legendary = 1 AND s.mythical = 0""")
def search_flags_generation(spark, sf):
    return _search_output(catalogue_search(warehouse_catalogue(spark, sf), generation=4, legendary=True, mythical=False))


@query("search_form_and_category", f"""WITH {ROLE_SQL} SELECT {SEARCH_COLUMNS} {SEARCH_FROM}
WHERE f.is_mega = 1 AND f.short_form = 'large'""")
def search_form_and_category(spark, sf):
    return _search_output(catalogue_search(warehouse_catalogue(spark, sf), form="Large", form_category="mega"))


@query("search_sheet_filters", f"""WITH {ROLE_SQL} SELECT {SEARCH_COLUMNS} {SEARCH_FROM}
JOIN sheet t ON t.source_row = e.entity_id
WHERE f.is_default = 1 AND list_contains(string_split(t.sous_groupe, ' ; '), 'ring')""")
def search_sheet_filters(spark, sf):
    return _search_output(catalogue_search(warehouse_catalogue(spark, sf), subgroup="Ring"))


@query("search_superlative_total", f"""WITH {ROLE_SQL}, ranked AS (
    SELECT {SEARCH_COLUMNS}, CAST(t.pv + t.attaque + t.defense + t.attaque_speciale + t.defense_speciale + t.vitesse AS BIGINT) AS total
    {SEARCH_FROM} JOIN sheet t ON t.source_row = e.entity_id WHERE f.is_default = 1)
SELECT form_id, name_fr, entity_id, type_1_fr, type_2_fr, generation, total FROM ranked
WHERE total = (SELECT max(total) FROM ranked)""")
def search_superlative_total(spark, sf):
    rows = catalogue_search(warehouse_catalogue(spark, sf), sort_by="base-stat-total", sort_order="desc", best_only=True)
    return _search_output(rows, F.col("base_stat_total").cast("long").alias("total"))


@query("search_superlative_ties", f"""WITH {ROLE_SQL}, ranked AS (
    SELECT {SEARCH_COLUMNS}, CAST(t.vitesse AS BIGINT) AS speed
    {SEARCH_FROM} JOIN sheet t ON t.source_row = e.entity_id WHERE f.is_default = 1)
SELECT form_id, name_fr, entity_id, type_1_fr, type_2_fr, generation, speed FROM ranked
WHERE speed = (SELECT min(speed) FROM ranked)""")
def search_superlative_ties(spark, sf):
    rows = catalogue_search(warehouse_catalogue(spark, sf), sort_by="Vitesse", best_only=True)
    return _search_output(rows, F.col("base_speed").cast("long").alias("speed"))


@query("search_measure_order", f"""WITH {ROLE_SQL}
SELECT {SEARCH_COLUMNS}, round(nullif(p.p_size % 50, 0) / 10.0, 3) AS height {SEARCH_FROM} JOIN part p ON p.p_partkey = e.entity_id
WHERE f.is_default = 1 AND p.p_size % 50 <> 0
ORDER BY height DESC, e.entity_id LIMIT 40 OFFSET 20""")
def search_measure_order(spark, sf):
    from lorespark.plans.search import plan_search

    planned = plan_search(warehouse_catalogue(spark, sf), sort_by="height", sort_order="desc")
    return _search_output(planned.page(40, 20), F.round("base_stat_value", 3).alias("height"))


_LATEST_SQL = "latest AS (SELECT entity_id, max(y) AS y FROM learn GROUP BY entity_id)"


@query("search_moves_same_row", f"""WITH {ROLE_SQL}, {_LATEST_SQL}
SELECT {SEARCH_COLUMNS}, 'year-' || l.y AS version_group {SEARCH_FROM} JOIN latest l ON l.entity_id = e.entity_id
WHERE f.is_default = 1 AND EXISTS (SELECT 1 FROM learn q JOIN move m ON m.move_id = q.move_id
    WHERE q.entity_id = e.entity_id AND q.y = l.y AND m.damage_class_id = 2 AND m.power >= 40 AND m.power <= 120)""")
def search_moves_same_row(spark, sf):
    rows = catalogue_search(warehouse_catalogue(spark, sf), damage_class="physical", min_power=40, max_power=120)
    return _search_output(rows, "version_group")


@query("search_moves_with_method", f"""WITH {ROLE_SQL}, chosen AS (
    SELECT entity_id, coalesce(max(y) FILTER (method = 'level-up'), max(y)) AS y FROM learn GROUP BY entity_id)
SELECT {SEARCH_COLUMNS}, 'year-' || l.y AS version_group {SEARCH_FROM} JOIN chosen l ON l.entity_id = e.entity_id
WHERE f.is_default = 1 AND EXISTS (SELECT 1 FROM learn q JOIN move m ON m.move_id = q.move_id
    WHERE q.entity_id = e.entity_id AND q.y = l.y AND q.method = 'level-up' AND q.level >= 10 AND q.level <= 30 AND m.type_id = 5)""")
def search_moves_with_method(spark, sf):
    rows = catalogue_search(warehouse_catalogue(spark, sf), move_type="NATION_5", min_level=10, max_level=30)
    return _search_output(rows, "version_group")


@query("search_moves_fixed_game", f"""WITH {ROLE_SQL}
SELECT {SEARCH_COLUMNS}, 'year-1997' AS version_group {SEARCH_FROM}
WHERE f.is_default = 1 AND EXISTS (SELECT 1 FROM learn q JOIN move m ON m.move_id = q.move_id
    WHERE q.entity_id = e.entity_id AND q.y = 1997 AND q.method = 'machine' AND m.damage_class_id = 3)""")
def search_moves_fixed_game(spark, sf):
    rows = catalogue_search(warehouse_catalogue(spark, sf), version_group="year-1997", damage_class="spéciale", learning_method="machine")
    return _search_output(rows, "version_group")


@query("missing_default_forms", """
SELECT CAST(p_partkey AS BIGINT) AS species_id, replace(p_name, ' ', '-') || '-' || p_partkey AS name_fr
FROM part WHERE p_brand <> 'Brand#1' AND p_size < 25""")
def missing_default_forms_query(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    partial = {role: cat[role] for role in ("species", "entity", "form")}
    partial["entry"] = cat["entry"].join(cat["sheet"].filter("pv >= 25").select("source_row"), "source_row", "left_semi")
    return missing_default_forms(Catalogue(partial)).select(F.col("species_id").cast("long").alias("species_id"), "name_fr")


# ---- games and moves -------------------------------------------------------


@query("latest_group_per_entity", """
SELECT o_custkey, max(year(o_orderdate)) AS latest_year, count(DISTINCT year(o_orderdate)) AS years
FROM orders GROUP BY o_custkey""")
def latest_group_per_entity(spark, sf):
    fact = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("game_id"))
    per_game = latest.games_with_data(fact, ["o_custkey"], "game_id")
    return per_game.groupBy("o_custkey").agg(
        F.max_by("game_id", F.struct("game_id")).cast("long").alias("latest_year"), F.count(F.lit(1)).alias("years"))


@query("latest_group_having_method", """
WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority FROM orders)
SELECT o_custkey, coalesce(max(y) FILTER (o_orderpriority = '1-URGENT'), max(y)) AS latest_year FROM f GROUP BY o_custkey""")
def latest_group_having_method(spark, sf):
    fact = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("game_id"), "o_orderpriority")
    games = fact.select("game_id").distinct().withColumn("order", F.col("game_id")).withColumn("generation_id", F.lit(0))
    chosen = latest.latest_game(fact, games, ["o_custkey"], method=F.col("o_orderpriority") == "1-URGENT")
    return chosen.select("o_custkey", F.col("game_id").cast("long").alias("latest_year"))


@query("latest_group_strict_method", """
SELECT o_custkey, max(year(o_orderdate)) AS latest_year FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey""")
def latest_group_strict_method(spark, sf):
    fact = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("game_id"), "o_orderpriority")
    games = fact.select("game_id").distinct().withColumn("order", F.col("game_id"))
    chosen = latest.latest_game(
        fact, games, ["o_custkey"], chronology=("order", "game_id"),
        method=F.col("o_orderpriority") == "1-URGENT", strict_method=True)
    return chosen.select("o_custkey", F.col("game_id").cast("long").alias("latest_year"))


@query("moves_in_latest_group", f"""WITH {ROLE_SQL}, {_LATEST_SQL}, pairs AS (
    SELECT DISTINCT q.entity_id, q.y, q.move_id, q.method, q.level FROM learn q JOIN latest USING (entity_id, y))
SELECT CAST(entity_id AS BIGINT) AS entity_id, CAST(y AS BIGINT) AS game_year, CAST(move_id AS BIGINT) AS move_id, m.name_fr,
    CAST(m.power AS BIGINT) AS power,
    CASE m.damage_class_id WHEN 1 THEN 'statut' WHEN 2 THEN 'physique' ELSE 'spéciale' END AS damage_class_fr,
    string_agg(method || ':' || level, ',' ORDER BY method, level) AS learning
FROM pairs JOIN move m USING (move_id) GROUP BY ALL""")
def moves_in_latest_group(spark, sf):
    rows = moves.entity_moves(warehouse_catalogue(spark, sf), moves.MoveFilter())
    learning = F.array_join(F.transform("learning", lambda item: F.concat(item["method"], F.lit(":"), item["level"])), ",")
    return rows.select(
        F.col("entity_id").cast("long").alias("entity_id"), (3000 - F.col("game_id")).cast("long").alias("game_year"),
        F.col("move_id").cast("long").alias("move_id"), "name_fr", F.col("power").cast("long").alias("power"),
        "damage_class_fr", learning.alias("learning"))


@query("moves_filtered_before_nothing", f"""WITH {ROLE_SQL}, {_LATEST_SQL}
SELECT CAST(q.entity_id AS BIGINT) AS entity_id, count(DISTINCT q.move_id) AS moves FROM learn q JOIN latest USING (entity_id, y)
JOIN move m USING (move_id) WHERE m.power > 150 AND m.damage_class_id = 1 GROUP BY q.entity_id""")
def moves_filtered_before_nothing(spark, sf):
    rows = moves.entity_moves(warehouse_catalogue(spark, sf), moves.MoveFilter(damage_class_id=1, min_power=151))
    return rows.groupBy(F.col("entity_id").cast("long").alias("entity_id")).agg(F.count(F.lit(1)).alias("moves"))


@query("learning_methods_all_versions", f"""WITH {ROLE_SQL}
SELECT DISTINCT CAST(entity_id AS BIGINT) AS entity_id, CAST(move_id AS BIGINT) AS move_id, CAST(level AS BIGINT) AS level,
    CAST(ord AS BIGINT) AS move_order, method, 'year-' || y AS version_group FROM learn""")
def learning_methods_all_versions(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    learn = dealt(cat["learn"], "entity_id", "move_id", "level", "order", "game_id", "method_id")
    rows = moves.learning_methods(cat, moves.selected_learn(cat, learn, ["entity_id"], None, True))
    return rows.select(
        F.col("entity_id").cast("long").alias("entity_id"), F.col("move_id").cast("long").alias("move_id"),
        F.col("level").cast("long").alias("level"), F.col("move_order").cast("long").alias("move_order"), "method", "version_group")


@query("level_up_moves_latest", f"""WITH {ROLE_SQL}, chosen AS (
    SELECT entity_id, max(y) AS y FROM learn WHERE method = 'level-up' GROUP BY entity_id)
SELECT DISTINCT CAST(q.entity_id AS BIGINT) AS entity_id, CAST(q.move_id AS BIGINT) AS move_id, m.name_fr,
    CAST(q.level AS BIGINT) AS level, CAST(q.ord AS BIGINT) AS move_order, 'year-' || q.y AS version_group
FROM learn q JOIN chosen USING (entity_id, y) JOIN move m USING (move_id)
WHERE q.method = 'level-up' AND q.level BETWEEN 5 AND 45""")
def level_up_moves_latest(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    chosen = moves.selected_learn(cat, cat["learn"], ["entity_id"], None, False, "level-up")
    rows = moves.level_up_moves(cat, chosen, 5, 45)
    return rows.select(
        F.col("entity_id").cast("long").alias("entity_id"), F.col("move_id").cast("long").alias("move_id"), "name_fr",
        F.col("level").cast("long").alias("level"), F.col("order").cast("long").alias("move_order"), "version_group")


@query("machine_moves_latest", f"""WITH {ROLE_SQL}, chosen AS (
    SELECT entity_id, max(y) AS y FROM learn WHERE method = 'machine' GROUP BY entity_id),
machine AS (SELECT move_id, y, min(ord) AS machine_number FROM learn WHERE method = 'machine' GROUP BY move_id, y)
SELECT DISTINCT CAST(q.entity_id AS BIGINT) AS entity_id, CAST(q.move_id AS BIGINT) AS move_id, 'year-' || q.y AS version_group,
    CAST(k.machine_number AS BIGINT) AS machine_number
FROM learn q JOIN chosen USING (entity_id, y) LEFT JOIN machine k ON k.move_id = q.move_id AND k.y = q.y WHERE q.method = 'machine'""")
def machine_moves_latest(spark, sf):
    cat = warehouse_catalogue(spark, sf)
    chosen = moves.selected_learn(cat, cat["learn"], ["entity_id"], None, False, "machine")
    rows = moves.machine_moves(cat, chosen)
    return rows.select(
        F.col("entity_id").cast("long").alias("entity_id"), F.col("move_id").cast("long").alias("move_id"), "version_group",
        F.col("machine_number").cast("long").alias("machine_number"))


@query("missing_groups_since_first", """
WITH p AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), y AS (SELECT DISTINCT y FROM p),
f AS (SELECT o_custkey, min(y) AS first_year FROM p GROUP BY o_custkey)
SELECT f.o_custkey, f.first_year, y.y AS missing_year FROM f JOIN y ON y.y > f.first_year
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.o_custkey = f.o_custkey AND p.y = y.y)""")
def missing_groups_since_first(spark, sf):
    fact = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("game_id"))
    games = fact.select("game_id").distinct().withColumn("order", F.col("game_id"))
    rows = latest.missing_games_since_first(fact, games, ["o_custkey"])
    return rows.select(
        "o_custkey", F.col("first_order").cast("long").alias("first_year"), F.col("game_id").cast("long").alias("missing_year"))


@query("first_group_per_entity", "SELECT o_custkey, min(year(o_orderdate)) AS first_year FROM orders GROUP BY o_custkey")
def first_group_per_entity(spark, sf):
    fact = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("game_id"))
    games = fact.select("game_id").distinct().withColumn("order", F.col("game_id"))
    return latest.first_game_order(fact, games, ["o_custkey"]).select("o_custkey", F.col("first_order").cast("long").alias("first_year"))


# ---- labels, views, integrity ----------------------------------------------


@query("label_fallback_view", """
SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) END, r_name, n_name) AS name_fr,
    coalesce(r_name, n_name) AS name_en FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def label_fallback_view(spark, sf):
    nation = table(spark, sf, "nation")
    french = nation.filter("n_nationkey % 3 = 0").select("n_nationkey", F.lit(5).alias("local_language_id"), F.lower("n_name").alias("name"))
    english = nation.join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        "n_nationkey", F.lit(9).alias("local_language_id"), F.col("r_name").alias("name"))
    view = labels.label_view(
        nation.withColumnRenamed("n_name", "identifier"), french.unionByName(english),
        base_key="n_nationkey", names_key="n_nationkey", fr=F.lit(5), en=F.lit(9))
    return view.select("n_nationkey", "name_fr", "name_en")


@query("pivot_conditional_max", """
SELECT max(CASE WHEN r_name = 'EUROPE' THEN r_regionkey END) AS fr, max(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS en FROM region""")
def pivot_conditional_max(spark, sf):
    codes = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("id"),
        F.when(F.col("r_name") == "EUROPE", "fr").when(F.col("r_name") == "ASIA", "en").alias("identifier"))
    return labels.language_ids(codes)


@query("fk_orphans_report", """
SELECT 'lineitem_orders' AS check_name, count(*) AS bad_rows FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'lineitem_part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'lineitem_supplier', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'lineitem_small_part', count(*) FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_type = 'SMALL')
UNION ALL SELECT 'order_status', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> l_linestatus
UNION ALL SELECT 'order_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def fk_orphans_report(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    return integrity.report([
        integrity.orphan_count("lineitem_orders", line, "l_orderkey", orders, "o_orderkey"),
        integrity.orphan_count("lineitem_part", line, "l_partkey", part, "p_partkey"),
        integrity.orphan_count("lineitem_supplier", line, "l_suppkey", supplier, "s_suppkey"),
        integrity.orphan_count("lineitem_small_part", line, "l_partkey", part.filter("p_type = 'SMALL'"), "p_partkey"),
        integrity.disagreement_count(
            "order_status", line, orders, F.col("o_orderkey") == F.col("l_orderkey"), F.col("o_orderstatus") != F.col("l_linestatus")),
        integrity.duplicate_count("order_line", line, ["l_orderkey", "l_linenumber"]),
    ])


@query("cross_column_null_safe_diff", """
WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
SELECT p, count(*) AS n FROM a WHERE s IS DISTINCT FROM (CASE WHEN p IS NULL THEN NULL ELSE 'F' END) GROUP BY p""")
def cross_column_null_safe_diff(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"))
    expected = F.when(F.col("p").isNotNull(), F.lit("F"))
    return rows.filter(integrity.null_safe_difference(F.col("s"), expected)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("status_histogram", """
SELECT coalesce(nullif(o_orderstatus, 'P'), '[vide]') AS status, count(*) AS n FROM orders GROUP BY 1""")
def status_histogram(spark, sf):
    rows = table(spark, sf, "orders").withColumn("status_or_null", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return integrity.status_histogram(rows, "status_or_null")


@query("missing_numbers_audit", """
SELECT CAST(k AS BIGINT) AS doc_id FROM range(0, (SELECT max(doc_id) + 1 FROM documents)) r(k)
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = k)""")
def missing_numbers_audit(spark, sf):
    documents = table(spark, sf, "documents")
    last = documents.agg(F.max("doc_id")).first()[0]
    return integrity.missing_numbers(table(spark, sf, "labels"), "doc_id", 0, last)


# ---- joins, sets, aggregates ------------------------------------------------


@query("superlative_with_ties", """
SELECT p_partkey, p_name, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)""")
def superlative_with_ties(spark, sf):
    return ranking.superlative(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), F.col("p_size"), True)


@query("topk_stable_paged", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_custkey, o_orderkey LIMIT 50 OFFSET 25""")
def topk_stable_paged(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ranking.page_rows(rows, [F.desc_nulls_last("o_totalprice"), F.asc("o_custkey"), F.asc("o_orderkey")], 50, 25)


@query("total_of_columns_rank", """
WITH t AS (SELECT l_partkey, sum(l_quantity) AS a, sum(l_extendedprice) AS b,
    CASE WHEN count(*) > 5 THEN sum(l_extendedprice * l_discount) END AS c FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(a + b + c, 4) AS total FROM t WHERE a + b + c IS NOT NULL ORDER BY round(a + b + c, 4) DESC, l_partkey LIMIT 100""")
def total_of_columns_rank(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b"),
        F.when(F.count(F.lit(1)) > 5, F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("c"))
    rows = totals.select("l_partkey", F.round(F.col("a") + F.col("b") + F.col("c"), 4).alias("total")).filter("total IS NOT NULL")
    return ranking.page_rows(rows, [F.desc("total"), F.asc("l_partkey")], 100, 0)


@query("exists_same_row_filters", """
SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 300000)""")
def exists_same_row_filters(spark, sf):
    same_row = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F") & predicates.within(F.col("o_totalprice"), 100000, 300000)
    orders = table(spark, sf, "orders").filter(same_row).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@query("anti_missing_defaults", """
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997)""")
def anti_missing_defaults(spark, sf):
    orders = table(spark, sf, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1997))
    return table(spark, sf, "customer").select("c_custkey").join(
        orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("left_join_composite", """
WITH k AS (SELECT l_suppkey, year(l_shipdate) AS y, min(l_linenumber) AS number FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1, 2)
SELECT l.l_suppkey, year(l.l_shipdate) AS ship_year, CAST(k.number AS BIGINT) AS number, count(*) AS n
FROM lineitem l LEFT JOIN k ON k.l_suppkey = l.l_suppkey AND k.y = year(l.l_shipdate) GROUP BY 1, 2, 3""")
def left_join_composite(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long"))
    numbered = line.filter("l_returnflag = 'R' AND l_quantity > 45").groupBy("l_suppkey", "ship_year").agg(
        F.min("l_linenumber").cast("long").alias("number"))
    # Rows are counted per key before the join, so a frequent key is joined once.
    counted = line.groupBy("l_suppkey", "ship_year").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(numbered, ["l_suppkey", "ship_year"], "left").select("l_suppkey", "ship_year", "number", "n")


@query("rarity_ranges", """
SELECT l_partkey, CAST(min(l_quantity) AS BIGINT) AS lowest, CAST(max(l_quantity) AS BIGINT) AS highest,
    min(year(l_shipdate)) AS first_generation, max(year(l_shipdate)) AS last_generation
FROM lineitem WHERE year(l_shipdate) IN (1996, 1998, 2000) GROUP BY l_partkey""")
def rarity_ranges(spark, sf):
    line = table(spark, sf, "lineitem")
    held = line.select("l_partkey", F.year("l_shipdate").alias("version_id"), F.col("l_quantity").cast("long").alias("rarity"))
    years = line.select(F.year("l_shipdate").alias("version_id")).distinct()
    versions = years.withColumn("game_id", F.col("version_id"))
    games = years.filter(F.col("version_id").isin(1996, 1998, 2000)).select(
        F.col("version_id").alias("game_id"), F.col("version_id").cast("long").alias("generation_id"))
    return history.rarity_ranges(held, versions, games, ["l_partkey"])


@query("ordered_string_agg", """
SELECT n_regionkey, string_agg(n_name, ' ou ' ORDER BY n_nationkey) AS names, count(*) AS n FROM nation GROUP BY n_regionkey""")
def ordered_string_agg(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(
        history.ordered_text(["n_nationkey"], F.col("n_name"), " ou ").alias("names"), F.count(F.lit(1)).alias("n"))


_CHART_SQL = """chart AS (SELECT a.n_name AS attacker, a.n_nationkey AS attacker_id, t.n_name AS target,
    CASE (a.n_nationkey * 7 + t.n_nationkey * 3) % 5 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 200 ELSE 100 END AS f FROM nation a, nation t)"""


@query("product_of_factors", f"""WITH {ROLE_SQL}, {_CHART_SQL}
SELECT CAST(e.entity_id AS BIGINT) AS entity_id, c1.attacker AS type, CAST(c1.attacker_id AS BIGINT) AS type_id,
    CAST((c1.f * coalesce(c2.f, 100)) // 100 AS BIGINT) AS factor
FROM entry e JOIN chart c1 ON c1.target = e.type_1_fr LEFT JOIN chart c2 ON c2.target = e.type_2_fr AND c2.attacker = c1.attacker
WHERE e.type_2_fr IS NULL OR e.type_2_fr IN (SELECT n_name FROM nation)""")
def product_of_factors(spark, sf):
    cat, nation = warehouse_catalogue(spark, sf), table(spark, sf, "nation")
    ids = nation.agg(F.collect_list("n_nationkey").alias("ids"))
    pairs = nation.select(F.col("n_nationkey").alias("damage_type_id"), F.explode(ids.scalar()).alias("target_type_id"))
    code = (F.col("damage_type_id") * 7 + F.col("target_type_id") * 3) % 5
    efficacy = pairs.withColumn("damage_factor", F.when(code == 0, 0).when(code == 1, 50).when(code == 2, 200).otherwise(100))
    entries = cat["entry"].select(
        "entity_id", F.col("type_1_fr").alias("type_1"), F.col("type_2_fr").alias("type_2"), F.array().cast("array<string>").alias("abilities"))
    names = nation.select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("name"))
    return type_factors(entries, efficacy, names, "entity_id").select(
        F.col("entity_id").cast("long").alias("entity_id"), "type", F.col("type_id").cast("long").alias("type_id"),
        F.col("factor").cast("long").alias("factor"))


@query("computed_key_self_join", """
SELECT b.s_suppkey AS entity_id FROM supplier b JOIN supplier g ON 's' || g.s_suppkey = 's' || b.s_suppkey || '1'""")
def computed_key_self_join(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.concat(F.lit("s"), "s_suppkey").alias("identifier"))
    return history.entities_with_suffix(suppliers, "1")


@query("sharing_count", """
SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS sharing FROM lineitem""")
def sharing_count(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    shared = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("sharing"))
    return line.join(shared, "l_partkey")


@query("split_multivalue_filter", """
SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red')""")
def split_multivalue_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return rows.filter(predicates.has_component(F.col("p_name"), "red", " "))


@query("known_values_union", """
SELECT DISTINCT value FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part
UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)""")
def known_values_union(spark, sf):
    part = table(spark, sf, "part")
    return Catalogue({"sheet": part.withColumn("brand", F.col("p_brand"))}).known_values(["p_name", "brand", "p_type"], " ")


@query("stage_prefix_filter", f"""WITH {ROLE_SQL} SELECT CAST(source_row AS BIGINT) AS source_row, stade_d_evolution FROM sheet
WHERE stade_d_evolution = 'SMALL' OR stade_d_evolution LIKE 'SMALL ·%'""")
def stage_prefix_filter(spark, sf):
    sheet = warehouse_catalogue(spark, sf)["sheet"].select(F.col("source_row").cast("long").alias("source_row"), "stade_d_evolution")
    return sheet.filter(predicates.has_stage(F.col("stade_d_evolution"), "SMALL"))


@query("ascii_name_sort", """
SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 100 OFFSET 10""")
def ascii_name_sort(spark, sf):
    from lorespark.functions.text import ascii_lower

    rows = table(spark, sf, "part").select("p_partkey", "p_name")
    return ranking.page_rows(rows, [ascii_lower(F.col("p_name")), F.asc("p_partkey")], 100, 10)


@query("first_record_per_key", """
SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1""")
def first_record_per_key(spark, sf):
    part = table(spark, sf, "part").select("p_name", "p_partkey", "p_brand")
    best = part.groupBy("p_name").agg(F.min_by(F.struct("p_partkey", "p_brand"), "p_partkey").alias("first"))
    return best.select("p_name", "first.p_partkey", "first.p_brand")


@query("golden_multiset_diff", """
WITH a AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
b AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.n, 0) - coalesce(b.n, 0) AS excess
FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def golden_multiset_diff(spark, sf):
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return evaluation.same_multiset(
        line.filter("l_returnflag = 'A'").drop("l_returnflag"), line.filter("l_returnflag = 'R'").drop("l_returnflag"))


@query("fifo_call_response_match", """
WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view')
SELECT c.user_id, c.event_id AS call_id, r.event_id AS response_id FROM c LEFT JOIN r ON r.user_id = c.user_id AND r.n = c.n""")
def fifo_call_response_match(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    number = lambda kind, name: traces.ordered_numbers(
        events.filter(F.col("event_type") == kind).withColumn("moment", F.struct("ts", "event_id")),
        ["user_id"], "moment", "n", F.to_date("ts")).select("user_id", "n", F.col("event_id").alias(name))
    return number("click", "call_id").join(number("view", "response_id"), ["user_id", "n"], "left").select("user_id", "call_id", "response_id")


# ---- traces and evaluation ---------------------------------------------------


@query("trace_percentiles", """
SELECT event_type AS label, count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events GROUP BY event_type""")
def trace_percentiles(spark, sf):
    rows = traces.time_summary(table(spark, sf, "events"), "event_type", "value")
    return rows.select("label", "count", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "min", "max")


@query("trace_overall_percentiles", """
SELECT count(*) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events""")
def trace_overall_percentiles(spark, sf):
    rows = traces.time_summary(table(spark, sf, "events"), None, "value")
    return rows.select("count", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")], "min", "max")


@query("nearest_rank_percentile", """
WITH o AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(l_extendedprice) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95,
    max(l_extendedprice) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50 FROM o GROUP BY l_returnflag""")
def nearest_rank_percentile(spark, sf):
    return nearest_rank_percentiles(
        table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p50": 0.5})


@query("trace_attempt_numbers", """
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events""")
def trace_attempt_numbers(spark, sf):
    events = table(spark, sf, "events").withColumn("moment", F.struct("ts", "event_id"))
    numbered = traces.ordered_numbers(events, ["user_id", "event_type"], "moment", "attempt", F.to_date("ts"))
    return numbered.select("event_id", "user_id", "event_type", "attempt")


def _attempts(spark, sf) -> DataFrame:
    """Events read as attempts: one in fifty counters is unknown, errors are their own type."""
    k = F.get_json_object("props", "$.k").cast("long")
    tokens = lambda factor: F.when(F.col("event_id") % 50 != 0, k * factor)
    return table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("step"), F.col("value").alias("duration_seconds"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS").alias("status"), F.col("event_type").alias("llm_name"),
        tokens(2).alias("prompt_tokens"), tokens(1).alias("completion_tokens"), tokens(3).alias("total_tokens"),
        F.create_map(F.lit("main_llm"), F.col("value"), F.lit("router"), F.col("value") / 10).alias("timings"))


_ATTEMPTS_SQL = """a AS (SELECT user_id, event_type, value, CASE WHEN event_id % 50 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k FROM events)"""


@query("trace_known_tokens", f"""WITH {_ATTEMPTS_SQL}
SELECT user_id, event_type AS llm_name, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors,
    round(sum(value), 6) AS duration_seconds, count(*) FILTER (k IS NULL) AS unknown_usage_calls,
    CAST(coalesce(sum(k), 0) AS BIGINT) AS known_completion_tokens, count(*) FILTER (k IS NULL) = 0 AS usage_complete,
    CASE WHEN count(*) FILTER (k IS NULL) = 0 THEN CAST(sum(k * 3) AS BIGINT) END AS total_tokens,
    CASE WHEN count(*) FILTER (k IS NULL) = 0 AND sum(value) > 0 THEN round(sum(k) / sum(value), 6) END AS tokens_per_second
FROM a GROUP BY 1, 2""")
def trace_known_tokens(spark, sf):
    rows = traces.usage_totals(_attempts(spark, sf), ["user_id"])
    return rows.select(
        "user_id", "llm_name", "calls", "errors", F.round("duration_seconds", 6).alias("duration_seconds"), "unknown_usage_calls",
        "known_completion_tokens", "usage_complete", "total_tokens", F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("trace_step_totals", f"""WITH {_ATTEMPTS_SQL}
SELECT event_type AS step, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS duration_seconds
FROM a GROUP BY 1""")
def trace_step_totals(spark, sf):
    return traces.step_totals(_attempts(spark, sf), []).withColumn("duration_seconds", F.round("duration_seconds", 4))


@query("trace_timing_totals", f"""WITH {_ATTEMPTS_SQL}
SELECT user_id, 'main_llm' AS component, round(sum(value), 4) AS seconds FROM a GROUP BY 1
UNION ALL SELECT user_id, 'router', round(sum(value / 10), 4) FROM a GROUP BY 1""")
def trace_timing_totals(spark, sf):
    return traces.timing_totals(_attempts(spark, sf), ["user_id"]).withColumn("seconds", F.round("seconds", 4))


@query("trace_component_summary", """
WITH v AS (SELECT 'router' AS component, value / 10 AS v FROM events UNION ALL SELECT 'main_llm', value FROM events)
SELECT component, count(*) AS count, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.95), 5) AS p95
FROM v GROUP BY component""")
def trace_component_summary(spark, sf):
    rows = traces.component_summary(_attempts(spark, sf))
    return rows.select("component", "count", *[F.round(c, 5).alias(c) for c in ("mean", "median", "p95")])


@query("trace_decision_histogram", """
SELECT coalesce(nullif(event_type, 'error'), 'N/A') AS decision, count(*) AS n FROM events GROUP BY 1""")
def trace_decision_histogram(spark, sf):
    rows = table(spark, sf, "events").withColumn("grounding_decision", F.nullif(F.col("event_type"), F.lit("error")))
    return traces.decision_histogram(rows)


@query("trace_retry_summary", """
SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS retrieval_retries,
    CAST(sum(CASE WHEN event_type = 'click' THEN 2 ELSE 0 END) AS BIGINT) AS generation_retries,
    count(*) FILTER (event_type IN ('view', 'click')) AS traces_with_retry FROM events""")
def trace_retry_summary(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").withColumn("retries", F.struct(
        F.when(kind == "view", 1).alias("retrieval"), F.when(kind == "click", 2).otherwise(0).alias("generation")))
    return traces.retry_summary(rows)


@query("slowest_topn", """
SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25""")
def slowest_topn(spark, sf):
    return traces.slowest(table(spark, sf, "events").select("event_id", "user_id", "value"), 25, F.col("value"), ["event_id"])


@query("json_props_extract", """
SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total_k, min(CAST(props->>'$.k' AS BIGINT)) AS min_k,
    count(DISTINCT props->>'$.k') AS distinct_k FROM events GROUP BY event_type""")
def json_props_extract(spark, sf):
    k = F.from_json("props", "k BIGINT")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.sum(k).alias("total_k"), F.min(k).alias("min_k"), F.countDistinct(k).alias("distinct_k"))


@query("confusion_matrix", "SELECT CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return evaluation.confusion(rows, "quality", "toxic")


@query("accuracy_by_match", """
SELECT count(*) AS cases, count(*) FILTER (quality = toxic) AS correct, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels""")
def accuracy_by_match(spark, sf):
    rows = evaluation.accuracy(table(spark, sf, "labels"), F.col("quality"), F.col("toxic"))
    return rows.withColumn("accuracy", F.round("accuracy", 6))
