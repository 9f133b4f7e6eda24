"""The sales warehouse seen as a catalogue.

Role mapping: an entity is a part, a move is a supplier, the learning relation is the
line items, a game is a shipping year, a method is a return flag, types are nations.
The operations then run on whole warehouse tables exactly as on the source catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.plans.catalogue import Catalogue
from lorespark.session import table


def warehouse_catalogue(spark: SparkSession, folder: str) -> Catalogue:
    part, supplier = table(spark, folder, "part"), table(spark, folder, "supplier")
    nation, lineitem = table(spark, folder, "nation"), table(spark, folder, "lineitem")
    identifier = "replace(p_name, ' ', '-') || '-' || p_partkey"
    tables = {
        "species": part.selectExpr(
            "p_partkey AS species_id", f"{identifier} AS identifier", "p_size % 9 + 1 AS generation_id",
            "CAST(p_partkey - 1 AS BIGINT) AS evolves_from_species_id",
            "CAST(CASE WHEN p_size >= 40 THEN 1 ELSE 0 END AS STRING) AS is_legendary",
            "CAST(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS STRING) AS is_mythical",
            "CAST(p_size * 5 AS STRING) AS capture_rate"),
        "entity": part.selectExpr(
            "p_partkey AS entity_id", "p_partkey AS species_id", f"{identifier} AS identifier", "1 AS is_default",
            "p_size % 50 AS height", "CAST(p_retailprice AS INT) AS weight"),
        "form": part.selectExpr(
            "p_partkey AS form_id", "p_partkey AS entity_id", f"{identifier} AS identifier",
            "CASE WHEN p_brand = 'Brand#1' THEN lower(p_type) END AS form_identifier",
            "CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END AS is_default",
            "CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END AS is_mega"),
        "entry": part.selectExpr(
            "p_partkey AS entity_id", "p_partkey AS form_id", "p_partkey AS source_row", "p_partkey AS national_number",
            "p_name AS name_fr", "p_name AS name_en", "'NATION_' || (p_size % 25) AS type_1_fr",
            "CASE WHEN p_partkey % 3 <> 0 THEN 'NATION_' || (p_partkey % 25) END AS type_2_fr"),
        "sheet": part.selectExpr(
            "p_partkey AS source_row", "p_size AS pv", "CAST(p_partkey % 97 AS INT) AS attaque",
            "CAST(p_partkey % 89 AS INT) AS defense", "CAST(p_partkey % 83 AS INT) AS attaque_speciale",
            "CASE WHEN p_size % 10 <> 0 THEN p_size * 2 END AS defense_speciale", "CAST(p_partkey % 79 AS INT) AS vitesse",
            "replace(p_name, ' ', ' ; ') AS sous_groupe", "p_type || ' · ' || p_brand AS stade_d_evolution",
            "p_brand AS talent_1", "CASE WHEN p_size > 25 THEN p_type END AS talent_2", "CAST(NULL AS STRING) AS talent_cache"),
        "move": supplier.selectExpr(
            "s_suppkey AS move_id", "s_name AS identifier", "s_nationkey AS type_id", "CAST(s_suppkey % 3 + 1 AS INT) AS damage_class_id",
            "CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 50) AS INT) END AS power", "100 AS accuracy", "10 AS pp"),
        "move_label": supplier.selectExpr("s_suppkey AS move_id", "s_name AS identifier", "s_name AS name_fr", "s_name AS name_en"),
        "type_label": nation.selectExpr("n_nationkey AS type_id", "n_name AS identifier", "n_name AS name_fr", "n_name AS name_en"),
        "learn": lineitem.selectExpr(
            "l_partkey AS entity_id", "l_suppkey AS move_id", "3000 - year(l_shipdate) AS game_id", "ascii(l_returnflag) AS method_id",
            "CAST(l_quantity AS INT) AS level", "l_linenumber AS order"),
        "game": lineitem.selectExpr("year(l_shipdate) AS year").distinct().selectExpr(
            "3000 - year AS game_id", "'year-' || year AS identifier", "year - 1990 AS generation_id", "year AS order"),
        "method": lineitem.select("l_returnflag").distinct().selectExpr(
            "ascii(l_returnflag) AS method_id",
            "CASE l_returnflag WHEN 'A' THEN 'level-up' WHEN 'N' THEN 'machine' ELSE 'tutor' END AS identifier"),
        "machine": lineitem.filter("l_returnflag = 'N'").groupBy(
            F.col("l_suppkey").alias("move_id"), F.expr("3000 - year(l_shipdate)").alias("game_id")
        ).agg(F.min("l_linenumber").alias("machine_number")).withColumn("item_id", F.lit(None).cast("int")),
    }
    return Catalogue(tables)


# Oracle counterparts of the role tables, for the SQL side of the comparison.
ROLE_SQL = """
species AS (SELECT p_partkey AS species_id, replace(p_name, ' ', '-') || '-' || p_partkey AS identifier,
    p_size % 9 + 1 AS generation_id, CASE WHEN p_size >= 40 THEN 1 ELSE 0 END AS legendary,
    CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS mythical FROM part),
form AS (SELECT p_partkey AS form_id, replace(p_name, ' ', '-') || '-' || p_partkey AS form_identifier,
    CASE WHEN p_brand = 'Brand#1' THEN lower(p_type) END AS short_form,
    CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END AS is_default,
    CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END AS is_mega FROM part),
entry AS (SELECT p_partkey AS entity_id, p_name AS name_fr, p_name AS name_en,
    'NATION_' || (p_size % 25) AS type_1_fr,
    CASE WHEN p_partkey % 3 <> 0 THEN 'NATION_' || (p_partkey % 25) END AS type_2_fr FROM part),
sheet AS (SELECT p_partkey AS source_row, p_size AS pv, p_partkey % 97 AS attaque, p_partkey % 89 AS defense,
    p_partkey % 83 AS attaque_speciale, CASE WHEN p_size % 10 <> 0 THEN p_size * 2 END AS defense_speciale,
    p_partkey % 79 AS vitesse, replace(p_name, ' ', ' ; ') AS sous_groupe,
    p_type || ' · ' || p_brand AS stade_d_evolution FROM part),
move AS (SELECT s_suppkey AS move_id, s_name AS name_fr, s_nationkey AS type_id, s_suppkey % 3 + 1 AS damage_class_id,
    CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 50) AS INT) END AS power FROM supplier),
learn AS (SELECT l_partkey AS entity_id, l_suppkey AS move_id, year(l_shipdate) AS y,
    CASE l_returnflag WHEN 'A' THEN 'level-up' WHEN 'N' THEN 'machine' ELSE 'tutor' END AS method,
    CAST(floor(l_quantity) AS INT) AS level, l_linenumber AS ord FROM lineitem)
"""


def catalogue_search(cat: Catalogue, **arguments) -> DataFrame:
    """Matching rows of a search without a page, for whole-table comparison."""
    from lorespark.plans.search import plan_search

    return plan_search(cat, **arguments).matching
