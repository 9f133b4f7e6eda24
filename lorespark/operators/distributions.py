"""Exact order statistics without gathering a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in the memory of one
task. Here each group is cut into value ranges, the counts of the ranges tell which
range holds the wanted rank, and only that range is ranked row by row. The cuts are
approximate quantiles, which come out differently each time they are computed: they are
written once, and every step reads the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import let
from lorespark.session import written

RANGES, COARSE = 512, 23


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each key and named rank, the value at that rank of the ascending order.

    ``ranks`` are columns over ``n``, the number of non-null values of the key, and count
    from 0. Returns (keys, n, rank_name, rank_value).
    """
    counts = written(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Ranges are cut at quantiles of the distinct values, so outliers and dense places leave them equally long.
    cuts = F.array_distinct(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 4 * RANGES))
    bounds = counts.groupBy(*keys).agg(cuts.alias("cuts"), F.sum("c").alias("n"))
    # Cuts in groups of ``COARSE``: a value passes the last cuts of the groups, then the cuts of one group.
    starts = F.sequence(F.lit(1), F.greatest(F.size("cuts"), F.lit(1)), F.lit(COARSE))
    groups = F.transform(starts, lambda start: F.slice("cuts", start, COARSE))
    bounds = written(bounds.withColumn("groups", groups).select(
        *keys, "n", "groups", F.transform("groups", lambda group: F.element_at(group, -1)).alias("ends")))
    below = lambda values: F.size(F.filter(values, lambda cut: cut < F.col("v")))
    cell = let(below(F.col("ends")), lambda passed: passed * COARSE + F.coalesce(below(F.get("groups", passed)), F.lit(0)))
    placed = _join(counts, bounds, keys).withColumn("cell", cell.cast("int")).drop("groups", "ends")
    histogram = placed.groupBy(*keys, "cell").agg(F.sum("c").alias("cell_rows"), F.first("n").alias("n"))
    # One row per range: at most RANGES rows per key reach this window.
    cumulative = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumn("until", F.sum("cell_rows").over(cumulative))
    wanted = histogram.select(
        *keys, "cell", "n", (F.col("until") - F.col("cell_rows")).alias("before"), "until",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("rank_name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()
        ])).alias("w"),
    ).select("*", "w.rank_name", "w.rank").drop("w").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("until")))
    cells = wanted.select(*keys, "cell").distinct()
    inside = _join(placed.select(*keys, "cell", "v", "c"), cells, [*keys, "cell"], "left_semi")
    running = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("inner_until", F.sum("c").over(running))
    offset = F.col("rank") - F.col("before")
    return (
        _join(wanted, inside, [*keys, "cell"])
        .filter((offset < F.col("inner_until")) & (offset >= F.col("inner_until") - F.col("c")))
        .select(*keys, "n", "rank_name", F.col("v").alias("rank_value"))
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; without keys, the other side is one row."""
    if not keys:
        for column in right.columns:
            left = left.withColumn(column, right.select(column).scalar())
        return left
    other = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    met = F.lit(True)
    for key in keys:
        met = met & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    joined = left.join(other, met, how)
    return joined if how == "left_semi" else joined.drop(*[f"_right_{key}" for key in keys])


def linear_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by linear interpolation between the two neighbouring values."""
    position = {name: (F.col("n") - 1) * F.lit(fraction) for name, fraction in fractions.items()}
    ranks = {}
    for name in fractions:
        ranks[f"{name}|low"] = F.floor(position[name])
        ranks[f"{name}|high"] = F.ceil(position[name])
    found = order_statistics(df, keys, value, ranks)
    aggregates = []
    for name in fractions:
        low = F.max(F.when(F.col("rank_name") == f"{name}|low", F.col("rank_value")))
        high = F.max(F.when(F.col("rank_name") == f"{name}|high", F.col("rank_value")))
        weight = (F.first("n") - 1) * F.lit(fractions[name]) - F.floor((F.first("n") - 1) * F.lit(fractions[name]))
        aggregates.append((low * (1 - weight) + high * weight).alias(name))
    return found.groupBy(*keys).agg(*aggregates)


def nearest_rank_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, halves rounded to the even rank."""
    ranks = {
        name: F.greatest(F.least(F.bround((F.col("n") - 1) * F.lit(fraction)), F.col("n") - 1), F.lit(0))
        for name, fraction in fractions.items()
    }
    found = order_statistics(df, keys, value, ranks)
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("rank_name") == name, F.col("rank_value"))).alias(name) for name in fractions]
    )


def summarise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, median, p95, min and max per key; zeros for a key without values."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    percentiles = linear_percentiles(df, keys, value, {"median": 0.5, "p95": 0.95})
    joined = _join(moments, percentiles, keys, "left")
    zeros = [F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in ("mean", "median", "p95", "min", "max")]
    return joined.select(*keys, "count", *zeros)
