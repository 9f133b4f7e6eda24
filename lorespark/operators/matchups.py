"""Type chart: weaknesses, resistances and immunities of many entries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.plans.vocabulary import ABILITY_IMMUNITIES, MULTIPLIER_LABELS


def type_factors(entries: DataFrame, efficacy: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, type, type_id, factor): product of the factors of both types, in integers.

    ``names`` holds (type_id, name) in one language. An unknown second type gives no row
    at all, never the factors of the first type alone. Both factors come from one list
    per attacking type, so an entry is never joined to the chart twice.
    """
    targets = names.select(F.col("type_id").alias("target_type_id"), F.col("name").alias("target_name"))
    chart = (
        efficacy.join(targets, "target_type_id")
        .join(names.select(F.col("type_id").alias("damage_type_id"), F.col("name").alias("type")), "damage_type_id")
        .select("damage_type_id", "type", "target_name", "damage_factor")
    )
    first = chart.select("damage_type_id", "type", F.col("target_name").alias("type_1"), F.col("damage_factor").alias("f1"))
    second = chart.select("damage_type_id", F.col("target_name").alias("type_2"), F.col("damage_factor").alias("f2"))
    known = targets.select(F.col("target_name").alias("type_2"), F.lit(True).alias("known_second"))
    rows = (
        entries.withColumn("type_2", F.nullif(F.col("type_2"), F.lit("")))
        .join(known, "type_2", "left")
        .filter("type_2 IS NULL OR known_second")
        .join(first, "type_1")
        .join(second, ["damage_type_id", "type_2"], "left")
    )
    factor = F.expr("(f1 * coalesce(f2, 100)) div 100").cast("int")
    return rows.select(key, "abilities", "type", F.col("damage_type_id").alias("type_id"), factor.alias("factor"))


def immunity_map() -> Column:
    pairs = []
    for ability, immune_type in ABILITY_IMMUNITIES.items():
        pairs += [F.lit(ability), F.lit(immune_type)]
    return F.create_map(*pairs)


def type_matchups(entries: DataFrame, efficacy: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, weaknesses, resistances, immunities) as texts.

    ``entries`` holds key, type_1, type_2 and ``abilities`` in slot order. A type that
    every ability cancels is an immunity; when only some do, the multiplier stays and
    the abilities are named.
    """
    rows = type_factors(entries, efficacy, names, key)
    held = F.filter(F.col("abilities"), lambda ability: ability.isNotNull() & (ability != ""))
    rows = rows.withColumn("held", held)
    granting = F.filter(F.col("held"), lambda ability: F.element_at(immunity_map(), ability) == F.col("type"))
    rows = rows.withColumn("granting", granting).withColumns({
        "granted_by": F.when(F.size("granting") > 0, F.array_join("granting", " ou ")),
        "every_ability": F.size("granting") == F.size("held"),
    }).filter("factor <> 100 OR granted_by IS NOT NULL")
    multiplier = F.lit(None).cast("string")
    for value, label in MULTIPLIER_LABELS.items():
        multiplier = F.when(F.col("factor") == value, label).otherwise(multiplier)
    by_factor = F.when(F.col("factor") > 100, "weakness").when(F.col("factor") > 0, "resistance").otherwise("immunity")
    bare = F.col("granted_by").isNull() | (F.col("factor") == 0)
    category = F.when(bare, by_factor).when(F.col("every_ability") | (F.col("factor") == 100), "immunity").otherwise(by_factor)
    text = (
        F.when(bare, F.concat("type", F.when(F.col("factor") != 0, F.concat(F.lit(" ("), multiplier, F.lit(")"))).otherwise("")))
        .when(F.col("every_ability"), F.concat("type", F.lit(" (talent "), "granted_by", F.lit(")")))
        .when(F.col("factor") == 100, F.concat("type", F.lit(" (seulement s'il a le talent "), "granted_by", F.lit(")")))
        .otherwise(F.concat("type", F.lit(" ("), multiplier, F.lit(" ; immunisé seulement s'il a le talent "), "granted_by", F.lit(")")))
    )
    item = F.struct((-F.col("factor")).alias("rank"), "type_id", text.alias("text"))
    lists = rows.withColumn("category", category).withColumn("item", item).groupBy(key).agg(*[
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("category") == name, F.col("item")))), lambda element: element["text"]
        ), ", ").alias(name)
        for name in ("weakness", "resistance", "immunity")
    ])
    empty = F.lit("")
    return lists.select(
        key,
        F.coalesce(F.nullif(F.col("weakness"), empty), F.lit("aucune")).alias("weaknesses"),
        F.nullif(F.col("resistance"), empty).alias("resistances"),
        F.nullif(F.col("immunity"), empty).alias("immunities"),
    )
