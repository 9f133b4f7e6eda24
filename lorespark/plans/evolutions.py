"""One-hop evolutions with their conditions, as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.plans.catalogue import Catalogue
from lorespark.plans.vocabulary import EVOLUTION_TRIGGERS, LEVEL_UP_WITHOUT_LEVEL, PLAIN_CONDITIONS

# Conditions that name an object: condition -> (rule column, base role, names role, key).
LABELLED_CONDITIONS = {
    "trigger_item": ("trigger_item_id", "item", "item_name", "item_id"),
    "held_item": ("held_item_id", "item", "item_name", "item_id"),
    "known_move": ("known_move_id", "move", "move_name", "move_id"),
    "used_move": ("used_move_id", "move", "move_name", "move_id"),
    "location": ("location_id", "location", "location_name", "location_id"),
    "region": ("region_id", "region", "region_name", "region_id"),
    "known_move_type": ("known_move_type_id", "type", "type_name", "type_id"),
    "party_type": ("party_type_id", "type", "type_name", "type_id"),
}


def plain_condition(column: str) -> Column:
    """Value of a condition as text; empty and zero mean that the rule has no such condition."""
    text = F.col(column).cast("string")
    return F.when(~text.isin("", "0"), text)


def sparse_conditions(columns: list[str], kept_at_zero: str | None = None) -> Column:
    """Map of the conditions that a rule really has."""
    entries = []
    for column in columns:
        value = F.col(column).cast("string") if column == kept_at_zero else plain_condition(column)
        entries += [F.lit(column), value]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


def trigger_label(trigger: Column, has_level: Column) -> Column:
    """Label of a trigger; levelling up without a minimum level is spelled out."""
    pairs = []
    for identifier, label in EVOLUTION_TRIGGERS.items():
        pairs += [F.lit(identifier), F.lit(label)]
    return F.when((trigger == "level-up") & ~has_level, LEVEL_UP_WITHOUT_LEVEL).otherwise(
        F.element_at(F.create_map(*pairs), trigger)
    )


def species_struct(cat: Catalogue, key: str) -> DataFrame:
    """Species as a struct, under the given join key."""
    return cat.species_labels.select(
        F.col("species_id").alias(key),
        F.struct("species_id", "identifier", F.col("label_fr").alias("name_fr"), F.col("label_en").alias("name_en")).alias(key + "_info"),
    )


def form_struct(cat: Catalogue, key: str) -> DataFrame:
    return cat["form"].select(
        F.col("form_id").alias(key), F.struct("form_id", "identifier", "form_identifier").alias(key + "_info")
    )


def evolution_rules(cat: Catalogue) -> DataFrame:
    """Every evolution rule with its source and target species, trigger, game and conditions."""
    rules = cat["evolution"]
    target = cat["species"].select(
        F.col("species_id").alias("evolved_species_id"), F.col("evolves_from_species_id").alias("source_species_id")
    )
    triggers = cat["trigger"].select("evolution_trigger_id", F.col("identifier").alias("trigger"))
    games = cat["game"].select("game_id", F.col("identifier").alias("version_group"))
    rows = (
        rules.join(target, "evolved_species_id")
        .join(triggers, "evolution_trigger_id", "left")
        .join(games, "game_id", "left")
    )
    plain = [column for column in PLAIN_CONDITIONS if column in rules.columns]
    always = ["relative_physical_stats"] if "relative_physical_stats" in rules.columns else []
    rows = rows.withColumn("conditions", sparse_conditions(plain + always, kept_at_zero="relative_physical_stats"))
    named = []
    for condition, (column, base, names, key) in LABELLED_CONDITIONS.items():
        if column in rules.columns and cat.has(base) and cat.has(names):
            labels = cat.labels(base, names, key).select(
                F.col(key).alias(column), F.struct(F.col(key).alias("id"), "identifier", "name_fr", "name_en").alias(condition)
            )
            rows = rows.join(labels, column, "left")
            named.append(condition)
    if "gender_id" in rules.columns and cat.has("gender"):
        rows = rows.join(cat["gender"].select("gender_id", F.col("identifier").alias("gender")), "gender_id", "left")
        named.append("gender")
    for condition in ("party_species", "trade_species"):
        column = condition + "_id"
        if column in rules.columns:
            rows = rows.join(species_struct(cat, column), column, "left").withColumnRenamed(column + "_info", condition)
            named.append(condition)
    for column in ("required_form_id", "evolved_form_id"):
        rows = rows.join(form_struct(cat, column), column, "left")
    source, target = species_struct(cat, "source_species_id"), species_struct(cat, "evolved_species_id")
    rows = rows.join(source, "source_species_id", "left").join(target, "evolved_species_id", "left")
    has_level = F.map_contains_key(F.col("conditions"), F.lit("minimum_level"))
    return rows.select(
        "evolution_id", "source_species_id", "required_form_id", "game_id",
        F.struct(F.col("source_species_id_info").alias("species"), F.col("required_form_id_info").alias("form")).alias("from"),
        F.struct(F.col("evolved_species_id_info").alias("species"), F.col("evolved_form_id_info").alias("form")).alias("to"),
        "trigger", trigger_label(F.col("trigger"), has_level).alias("trigger_fr"), "version_group", "conditions",
        F.struct(*named).alias("named_conditions") if named else F.lit(None).alias("named_conditions"),
    )


def get_evolutions(cat: Catalogue, entity: str, form: str | None = None, version_group: str | None = None) -> dict:
    """Children of one species; a requested form keeps only the rules bound to it."""
    species = cat.resolve_species(entity)
    rules = evolution_rules(cat).filter(F.col("source_species_id") == species["species_id"])
    forms = cat.forms_of(species["species_id"], form).collect() if form else []
    if form:
        if not forms:
            raise ValueError(f"form {form!r} not found for {entity!r}")
        rules = rules.filter(F.col("required_form_id").isin([row["form_id"] for row in forms]))
    if version_group:
        rules = rules.filter(F.col("version_group") == version_group)
    rows = []
    for row in rules.orderBy(F.col("game_id").asc_nulls_first(), "evolution_id").collect():
        item = row.asDict(recursive=True)
        named = {key: value for key, value in (item.pop("named_conditions") or {}).items() if value is not None}
        rows.append({
            "evolution_id": item["evolution_id"],
            "from": {**(item["from"]["species"] or {}), "form": item["from"]["form"]},
            "to": {**(item["to"]["species"] or {}), "form": item["to"]["form"]},
            "trigger": item["trigger"], "version_group": item["version_group"],
            "conditions": {**item["conditions"], **named},
            **({"trigger_fr": item["trigger_fr"]} if item["trigger_fr"] else {}),
        })
    return {"operation": "get_evolutions", "entity": entity, "form": form, "version_group": version_group,
            "count": len(rows), "evolutions": rows}
