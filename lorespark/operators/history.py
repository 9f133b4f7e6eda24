"""Facts about the past of an entity: former abilities and statistics, held items, absences.

Each function answers for every entity at once; a lookup filters on the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.latest import games_with_data, missing_games_since_first
from lorespark.plans.vocabulary import FIRST_GENERATION_STAT, PAST_STATS


def ordered_text(order: list[str], text: Column, separator: str) -> Column:
    """Texts of a group joined in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return F.array_join(F.transform(items, lambda item: item["text"]), separator)


def former_abilities(past: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, text): each former ability with the last generation that had it."""
    text = F.concat(
        F.col("name"), F.lit(" ("), F.when(F.col("is_hidden") != 0, "talent caché, ").otherwise(""),
        F.lit("jusqu'à la G"), F.col("generation_id"), F.lit(", changé en G"), F.col("generation_id") + 1, F.lit(")"),
    )
    rows = past.join(names.select("ability_id", "name"), "ability_id")
    return rows.groupBy("entity_id").agg(ordered_text(["generation_id", "slot"], text, " ; ").alias("text"))


def former_stats(past: DataFrame) -> DataFrame:
    """(entity_id, text): former statistics; unknown statistic numbers are ignored."""
    label = F.lit(None).cast("string")
    for number, name in PAST_STATS.items():
        label = F.when(F.col("stat_id") == number, name).otherwise(label)
    until = F.when(F.col("stat_id") == FIRST_GENERATION_STAT, F.lit("(G1 seulement)")).otherwise(
        F.concat(F.lit("(jusqu'à la G"), F.col("generation_id"), F.lit(")"))
    )
    text = F.concat(label, F.lit(" : "), F.col("base_stat"), F.lit(" "), until)
    return past.filter(F.col("stat_id").isin(list(PAST_STATS))).groupBy("entity_id").agg(
        ordered_text(["generation_id", "stat_id"], text, " ; ").alias("text")
    )


def rarity_ranges(held: DataFrame, versions: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest rarity and generation of each key over the listed games."""
    return (
        held.join(versions.select("version_id", "game_id"), "version_id")
        .join(games.select("game_id", "generation_id"), "game_id")
        .groupBy(*keys)
        .agg(
            F.min("rarity").alias("lowest"), F.max("rarity").alias("highest"),
            F.min("generation_id").alias("first_generation"), F.max("generation_id").alias("last_generation"),
        )
    )


def held_items(held: DataFrame, versions: DataFrame, games: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, text): items held in the wild, the most frequent first."""
    ranges = rarity_ranges(held, versions, games, ["entity_id", "item_id"]).join(names.select("item_id", "name"), "item_id")
    rarity = F.when(F.col("lowest") == F.col("highest"), F.concat(F.col("lowest"), F.lit(" %"))).otherwise(
        F.concat(F.col("lowest"), F.lit(" à "), F.col("highest"), F.lit(" %"))
    )
    generations = F.when(
        F.col("first_generation") == F.col("last_generation"), F.concat(F.lit("G"), F.col("first_generation"))
    ).otherwise(F.concat(F.lit("G"), F.col("first_generation"), F.lit("–G"), F.col("last_generation")))
    text = F.concat(F.col("name"), F.lit(" ("), rarity, F.lit(", "), generations, F.lit(")"))
    return ranges.withColumn("rank", -F.col("highest")).groupBy("entity_id").agg(
        ordered_text(["rank", "name"], text, ", ").alias("text")
    )


def entities_with_suffix(entities: DataFrame, suffix: str) -> DataFrame:
    """Entities whose identifier plus the suffix is another entity: a join on a computed key."""
    base = entities.select("entity_id", F.concat(F.col("identifier"), F.lit(suffix)).alias("twin"))
    return base.join(entities.select(F.col("identifier").alias("twin")), "twin", "left_semi").select("entity_id")


def absences(learn: DataFrame, games: DataFrame) -> DataFrame:
    """(entity_id, text): games without data since the first one, ``aucun`` when there is none.

    ``games`` holds the labelled games only, with a ``label`` column.
    """
    known = learn.join(games.select("game_id"), "game_id", "left_semi")
    present = games_with_data(known, ["entity_id"], "game_id").select("entity_id").distinct()
    missing = missing_games_since_first(known, games, ["entity_id"]).join(games.select("game_id", "label"), "game_id")
    texts = missing.groupBy("entity_id").agg(ordered_text(["order"], F.col("label"), " ; ").alias("text"))
    return present.join(texts, "entity_id", "left").select("entity_id", F.coalesce("text", F.lit("aucun")).alias("text"))
