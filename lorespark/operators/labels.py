"""Bilingual labels with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def language_ids(languages: DataFrame, id_column: str = "id", code: str = "identifier") -> DataFrame:
    """One row (fr, en): the identifiers of the two languages."""
    return languages.agg(
        F.max(F.when(F.col(code) == "fr", F.col(id_column))).alias("fr"),
        F.max(F.when(F.col(code) == "en", F.col(id_column))).alias("en"),
    )


def names_by_object(names: DataFrame, key: str, fr: Column, en: Column, language: str = "local_language_id") -> DataFrame:
    """French and English name of each object in one pass over the names table.

    Two left joins to the same table would read and move it twice; one conditional
    aggregation gives both names.
    """
    return (
        names.filter((F.col(language) == fr) | (F.col(language) == en))
        .groupBy(key)
        .agg(
            F.max(F.when(F.col(language) == fr, F.col("name"))).alias("label_fr"),
            F.max(F.when(F.col(language) == en, F.col("name"))).alias("label_en"),
        )
    )


def label_view(base: DataFrame, names: DataFrame, *, base_key: str, names_key: str, fr: Column, en: Column) -> DataFrame:
    """(key, identifier, name_fr, name_en): French falls back to English, then to the identifier."""
    labels = names_by_object(names, names_key, fr, en).withColumnRenamed(names_key, "label_key")
    return (
        base.select(F.col(base_key).alias("object_key"), "identifier")
        .join(labels, F.col("object_key") == F.col("label_key"), "left")
        .select(
            F.col("object_key").alias(names_key),
            "identifier",
            F.coalesce("label_fr", "label_en", "identifier").alias("name_fr"),
            F.coalesce("label_en", "identifier").alias("name_en"),
        )
    )


def first_existing(df: DataFrame, candidates: list[str], output: str, required: bool = False) -> Column:
    """The first candidate column that exists, else NULL; a required one must exist."""
    for candidate in candidates:
        if candidate in df.columns:
            return df[candidate].alias(output)
    if required:
        raise ValueError(f"required column missing for {output}: " + " / ".join(candidates))
    return F.lit(None).cast("string").alias(output)
