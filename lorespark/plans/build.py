"""Offline build: link the sheets to the source tables, build the bilingual view, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators import integrity
from lorespark.operators.labels import first_existing
from lorespark.plans.catalogue import Catalogue
from lorespark.plans.vocabulary import LINK_COLUMNS, LINK_TEXT_COLUMNS, VIEW_COLUMNS


def linked_sheet(sheet: DataFrame) -> DataFrame:
    """Sheet with its three key columns; a blank cell gives no key."""
    missing = sorted(set([*LINK_COLUMNS.values(), *LINK_TEXT_COLUMNS.values()]) - set(sheet.columns))
    if missing:
        raise ValueError("mapping columns missing from the sheet: " + ", ".join(missing))
    key = lambda column: F.nullif(F.trim(F.col(column).cast("string")), F.lit("")).cast("int")
    return sheet.withColumns({role: key(column) for role, column in LINK_COLUMNS.items()})


def link_checks(cat: Catalogue, sheet: DataFrame) -> DataFrame:
    """Orphan keys and contradictions between the keys of a linked sheet; all must be zero."""
    entity = cat["entity"].select(F.col("entity_id").alias("known_entity"), F.col("species_id").alias("its_species"))
    form = cat["form"].select(F.col("form_id").alias("known_form"), F.col("entity_id").alias("its_entity"))
    return integrity.report([
        integrity.orphan_count("species_id", sheet, "species_id", cat["species"], "species_id"),
        integrity.orphan_count("entity_id", sheet, "entity_id", cat["entity"], "entity_id"),
        integrity.orphan_count("form_id", sheet, "form_id", cat["form"], "form_id"),
        integrity.disagreement_count("entity_species", sheet, entity, F.col("known_entity") == F.col("entity_id"),
                                     F.col("species_id") != F.col("its_species")),
        integrity.disagreement_count("form_entity", sheet, form, F.col("known_form") == F.col("form_id"),
                                     F.col("entity_id") != F.col("its_entity")),
    ])


def identifier_differences(cat: Catalogue, sheet: DataFrame) -> DataFrame:
    """Texts of the sheet that differ from the source; reported, never blocking."""
    written = lambda column: F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    entity = cat["entity"].select(F.col("entity_id").alias("known_entity"), F.col("identifier").alias("known_name"))
    form = cat["form"].select(F.col("form_id").alias("known_form"), F.col("form_identifier").alias("known_name"))
    return integrity.report([
        integrity.disagreement_count("entity_identifier", sheet, entity, F.col("known_entity") == F.col("entity_id"),
                                     F.col("known_name") != written(LINK_TEXT_COLUMNS["entity_identifier"])),
        integrity.disagreement_count("form_identifier", sheet, form, F.col("known_form") == F.col("form_id"),
                                     F.col("known_name") != written(LINK_TEXT_COLUMNS["form_identifier"])),
    ])


def bilingual_view(fr: DataFrame, en: DataFrame) -> DataFrame:
    """One row per French sheet row with the English columns beside; absent columns are null."""
    sides = {"fr": fr, "en": en}
    chosen: dict[str, list[Column]] = {"fr": [], "en": []}
    for output, (language, candidates, required) in VIEW_COLUMNS.items():
        chosen[language].append(first_existing(sides[language], candidates, output, required))
    links = [fr[column].alias(role) for role, column in LINK_TEXT_COLUMNS.items()]
    left = fr.select("source_row", *LINK_COLUMNS, *links, *chosen["fr"])
    right = en.select("source_row", *chosen["en"])
    return left.join(right, "source_row", "left")


def language_differences(fr: DataFrame, en: DataFrame) -> DataFrame:
    """Rows whose mapping differs between the two sheets, nulls and blanks being equal."""
    columns = [*LINK_COLUMNS.values(), LINK_TEXT_COLUMNS["mapping_status"]]
    text = lambda side, column: F.coalesce(F.col(f"{side}.{column}").cast("string"), F.lit(""))
    differs = F.lit(False)
    for column in columns:
        differs = differs | (text("fr", column) != text("en", column))
    joined = fr.alias("fr").join(en.alias("en"), F.col("fr.source_row") == F.col("en.source_row"))
    return joined.agg(F.count(F.when(differs, 1)).alias("bad_rows")).select(F.lit("mapping_by_language").alias("check_name"), "bad_rows")


def sheet_coverage(fr: DataFrame) -> DataFrame:
    return fr.agg(
        F.count(F.lit(1)).alias("rows"), F.count("species_id").alias("with_species"),
        F.countDistinct("species_id").alias("distinct_species"), F.count("entity_id").alias("with_entity"), F.count("form_id").alias("with_form"))


def build_catalogue(tables: dict[str, DataFrame], fr: DataFrame, en: DataFrame, expected_species: int | None = None) -> Catalogue:
    """Source tables and linked sheets as a validated catalogue."""
    base = Catalogue.from_source(tables)
    fr, en = linked_sheet(fr), linked_sheet(en)
    checks = link_checks(base, fr).unionByName(link_checks(base, en)).unionByName(language_differences(fr, en))
    integrity.require_clean(checks)
    if expected_species is not None:
        found = sheet_coverage(fr).first()["distinct_species"]
        if found != expected_species:
            raise ValueError(f"{expected_species} distinct species expected, {found} found")
    roles = {role: base[role] for role in base._tables}
    return Catalogue({**roles, "sheet": fr, "entry": bilingual_view(fr, en)})
