"""Superlatives, stable pages and bounded lists."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 100
DEFAULT_PAGE = 30


def require_integer(name: str, value: Any, minimum: int, maximum: int | None = None) -> None:
    """Accept ``None`` or a true integer in range; booleans are refused."""
    if value is None:
        return
    if type(value) is not int or value < minimum or (maximum is not None and value > maximum):
        raise ValueError(f"{name} must be an integer between {minimum} and {maximum if maximum is not None else 'any bound'}")


def require_page(limit: Any, offset: Any) -> None:
    if limit is None or offset is None:
        raise ValueError("limit and offset are required")
    require_integer("limit", limit, 0, MAX_PAGE)
    require_integer("offset", offset, 0)


@dataclass(frozen=True)
class Page:
    """One page of rows with the exact total before pagination."""

    rows: list[dict]
    total_count: int
    limit: int
    offset: int

    def envelope(self) -> dict[str, Any]:
        returned = len(self.rows)
        return {
            "results": self.rows,
            "total_count": self.total_count,
            "returned_count": returned,
            "limit": self.limit,
            "offset": self.offset,
            "truncated": self.total_count > returned,
            "has_more": self.offset + returned < self.total_count,
        }


def page_rows(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Sorted slice; planned as a bounded heap per partition, not as a full sort."""
    require_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def with_total(page: DataFrame, matching: DataFrame) -> DataFrame:
    """Attach the exact total as a scalar subquery instead of a window over all rows."""
    return page.withColumn("total_count", matching.agg(F.count(F.lit(1))).scalar())


def superlative(df: DataFrame, value: Column, descending: bool) -> DataFrame:
    """Every row that reaches the best value: one aggregate, then a filter, ties kept."""
    best = df.agg((F.max(value) if descending else F.min(value)).alias("best_value")).scalar()
    return df.filter(value == best)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """At most ``count`` rows per group, kept by order.

    Spark turns the rank filter into a group limit before the exchange, so a hot group
    sends ``count`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("group_position", F.row_number().over(window)).filter(F.col("group_position") <= count)


def ranked_topk(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """Top ``k`` rows of each group with their rank from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def fit_byte_budget(df: DataFrame, group: list[str], order: list[Column], payload: Column, budget: int) -> DataFrame:
    """Leading rows of each group whose cumulative size stays within the budget.

    Each row costs at least one byte, so no list can keep more than ``budget`` rows: the
    group limit runs before the exchange and bounds what one task accumulates.
    """
    sized = df.withColumn("row_bytes", F.greatest(F.octet_length(payload), F.lit(1)))
    leading = ranked_topk(sized, group, order, budget, "position")
    running = Window.partitionBy(*group).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return leading.withColumn("used_bytes", F.sum("row_bytes").over(running)).filter(F.col("used_bytes") <= budget)


def json_bytes(*columns: str) -> Column:
    """Bytes of a row as compact JSON, null fields included."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def fit_lists(
    rows: DataFrame, group: list[str], name: str, names: list[str], order: list[Column], size: Column, budget: int, overhead: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The rows that are left when several lists of one result share a byte budget, and the outcome of each result.

    While a result is too large, its largest list loses its last row (of equally large lists, the first of ``names``). A list of
    ``n`` rows is largest at some time only while all longer ones are gone, so rows go in falling order of the size of the list that ends
    with them: one running sum settles how many. A list that ends beyond the budget by itself always loses its last row, so each list
    is first cut to the budget, which bounds what a group gathers.

    The outcome (``group``, outcome, kept_rows, used_bytes) is ``whole``, ``truncated`` or ``too large``; in the last case, when
    nothing is left or the rest alone is too large, no row is kept. ``overhead`` counts the bytes of a result outside its lists.
    """
    rank = F.array_position(F.array(*map(F.lit, names)), F.col(name))
    sums = rows.groupBy(*group).agg(F.countDistinct(name).alias("lists"), F.count(F.lit(1)).alias("all_rows"))
    # A list takes two brackets, its rows, and a comma before each row but the first.
    leading = ranked_topk(rows.withColumn("row_bytes", F.greatest(size, F.lit(1))), [*group, name], order, budget, "position")
    leading = leading.withColumn("row_bytes", F.col("row_bytes") + (F.col("position") > 1).cast("int"))
    running = Window.partitionBy(*group, name).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    ended = leading.withColumn("list_bytes", F.sum("row_bytes").over(running) + 2).filter(F.col("list_bytes") <= budget)
    # Rows still there when this one is the next to go: itself and all whose list is smaller.
    falling = Window.partitionBy(*group).orderBy(F.col("list_bytes"), rank.desc()).rowsBetween(Window.unboundedPreceding, 0)
    kept = ended.join(sums.select(*group, "lists"), group).withColumn("used_bytes", F.sum("row_bytes").over(falling) + 2 * F.col("lists") + overhead).filter(
        F.col("used_bytes") <= budget).drop("lists")
    left = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("kept_rows"), F.max("used_bytes").alias("used_bytes"))
    outcome = F.when(F.col("kept_rows").isNull(), "too large").when(F.col("kept_rows") == F.col("all_rows"), "whole").otherwise("truncated")
    outcomes = sums.join(left, group, "left").select(*group, outcome.alias("outcome"), F.coalesce("kept_rows", F.lit(0)).alias("kept_rows"), "used_bytes")
    return kept.drop("row_bytes", "position", "list_bytes", "used_bytes"), outcomes
