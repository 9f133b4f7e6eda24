"""Integrity checks: each check is one row (check_name, bad_rows), so zero is visible too."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphan_count(name: str, child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys without a parent.

    Child keys are counted before the anti join: a key repeated over a third of the
    child crosses the network once.
    """
    keys = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("checked_key")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("checked_key"))
    missing = keys.join(known, "checked_key", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("bad_rows")).select(
        F.lit(name).alias("check_name"), "bad_rows"
    )


def disagreement_count(name: str, child: DataFrame, parent: DataFrame, on: Column, differs: Column) -> DataFrame:
    """Rows whose parent exists but contradicts them."""
    return child.join(parent, on).agg(F.count(F.when(differs, 1)).alias("bad_rows")).select(
        F.lit(name).alias("check_name"), "bad_rows"
    )


def duplicate_count(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are present more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("bad_rows")).select(F.lit(name).alias("check_name"), "bad_rows")


def null_safe_difference(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require_clean(checks: DataFrame) -> None:
    """Raise with the failing checks; the report holds one row per check."""
    failing = checks.filter("bad_rows > 0").collect()
    if failing:
        raise ValueError("; ".join(f"{row.check_name}: {row.bad_rows}" for row in failing))


def status_histogram(df: DataFrame, status: str) -> DataFrame:
    label = F.coalesce(F.col(status), F.lit("[vide]")).alias("status")
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def missing_numbers(found: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """Numbers of the expected range that were not found."""
    expected = found.sparkSession.range(first, last + 1).select(F.col("id").alias(column))
    return expected.join(found.select(F.col(column).cast("long")), column, "left_anti")
