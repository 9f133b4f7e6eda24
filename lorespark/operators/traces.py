"""Analytics over execution traces: attempts, timings, token usage, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.distributions import linear_percentiles, summarise

# Timed components, in report order, and token counters.
COMPONENTS = [
    "router", "retrieval", "retry_retrieval", "structured", "structured_parse", "structured_execution",
    "structured_format", "context", "main_llm", "grounding", "retry_llm",
]
TOKEN_FIELDS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def number_attempts(attempts: DataFrame, trace: list[str], order: list[str]) -> DataFrame:
    """Attempt number of each step inside its execution.

    The window is keyed by execution and step, so it holds the attempts of one step of
    one execution.
    """
    window = Window.partitionBy(*trace, "step").orderBy(*order)
    return attempts.withColumn("attempt", F.row_number().over(window))


def ordered_numbers(df: DataFrame, keys: list[str], order: str, output: str, block: Column) -> DataFrame:
    """Row numbers inside groups of any size.

    Rows are numbered inside (group, block) cells, where blocks are ordered ranges of the
    order column; the sizes of the earlier blocks are added. A group that holds a third
    of all rows is therefore numbered by as many tasks as it has blocks.
    """
    placed = df.withColumn("order_block", block)
    inner = Window.partitionBy(*keys, "order_block").orderBy(order)
    numbered = placed.withColumn("inner_number", F.row_number().over(inner))
    sizes = placed.groupBy(*keys, "order_block").agg(F.count(F.lit(1)).alias("block_rows"))
    before = Window.partitionBy(*keys).orderBy("order_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("block_rows").over(before), F.lit(0))).drop("block_rows")
    return (
        numbered.join(offsets, [*keys, "order_block"])
        .withColumn(output, (F.col("inner_number") + F.col("offset")).cast("long"))
        .drop("order_block", "inner_number", "offset")
    )


def step_totals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, errors and total duration per step."""
    return attempts.groupBy(*keys, "step").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("status") == "ERROR", 1)).alias("errors"),
        F.sum("duration_seconds").alias("duration_seconds"),
    )


def timing_totals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per timed component, over the attempts that carry it."""
    return (
        attempts.select(*keys, F.explode("timings").alias("component", "seconds"))
        .groupBy(*keys, "component").agg(F.sum("seconds").alias("seconds"))
    )


def usage_totals(attempts: DataFrame, keys: list[str], name: str = "llm_name") -> DataFrame:
    """Token totals per model call; one unknown count makes the totals unknown.

    Throughput is the total of tokens over the total of durations, never a sum of rates.
    """
    unknown = F.lit(False)
    for field in TOKEN_FIELDS:
        unknown = unknown | F.col(field).isNull()
    totals = attempts.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("status") == "ERROR", 1)).alias("errors"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.count(F.when(unknown, 1)).alias("unknown_usage_calls"),
        *[F.coalesce(F.sum(field), F.lit(0)).alias(f"known_{field}") for field in TOKEN_FIELDS],
    )
    complete = F.col("unknown_usage_calls") == 0
    totals = totals.withColumn("usage_complete", complete).withColumns(
        {field: F.when(complete, F.col(f"known_{field}")) for field in TOKEN_FIELDS}
    )
    rate = F.when(complete & (F.col("duration_seconds") > 0), F.col("completion_tokens") / F.col("duration_seconds"))
    return totals.withColumn("tokens_per_second", rate)


def time_summary(traces: DataFrame, key: str | None = None, value: str = "total_time") -> DataFrame:
    """Distribution of total times, overall or per label; a missing label is ``N/A``."""
    known = traces.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    if key is None:
        return summarise(known, [], value)
    labelled = known.withColumn("label", F.coalesce(F.col(key).cast("string"), F.lit("N/A")))
    return summarise(labelled, ["label"], value)


def component_summary(traces: DataFrame) -> DataFrame:
    """Distribution of each component over the traces that carry it, in report order."""
    values = traces.select(F.explode("timings").alias("component", "seconds")).filter(F.col("component").isin(COMPONENTS))
    values = values.withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    order = F.array_position(F.array(*[F.lit(name) for name in COMPONENTS]), F.col("component"))
    return summarise(values, ["component"], "seconds").withColumn("position", order)


def usage_distribution(traces: DataFrame, name: str) -> DataFrame:
    """Token and rate distributions of the calls whose usage is complete and not empty."""
    usage = traces.filter(F.col(name).isNotNull()).select(f"{name}.*")
    measured = usage.filter(
        F.coalesce("usage_complete", F.lit(True))
        & (F.coalesce("completion_tokens", F.lit(0)) > 0) & (F.coalesce("tokens_per_second", F.lit(0.0)) > 0)
    )
    long = measured.select(F.explode(F.array(*[
        F.struct(F.lit(field).alias("metric"), F.coalesce(F.col(field).cast("double"), F.lit(0.0)).alias("value"))
        for field in [*TOKEN_FIELDS, "tokens_per_second"]
    ])).alias("m")).select("m.metric", "m.value")
    return summarise(long, ["metric"], "value")


def retry_summary(traces: DataFrame) -> DataFrame:
    retrieval = F.coalesce(F.col("retries.retrieval"), F.lit(0))
    generation = F.coalesce(F.col("retries.generation"), F.lit(0))
    return traces.agg(
        F.coalesce(F.sum(retrieval), F.lit(0)).alias("retrieval_retries"),
        F.coalesce(F.sum(generation), F.lit(0)).alias("generation_retries"),
        F.count(F.when((retrieval > 0) | (generation > 0), 1)).alias("traces_with_retry"),
    )


def decision_histogram(traces: DataFrame, column: str = "grounding_decision") -> DataFrame:
    label = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("N/A")).alias("decision")
    return traces.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "decision")


def retrieval_medians(traces: DataFrame) -> DataFrame:
    """Median volumes of the traces that retrieved something."""
    count = lambda field: F.coalesce(F.col(f"retrieval.{field}"), F.lit(0))
    used = traces.filter((F.coalesce(F.try_element_at("timings", F.lit("retrieval")), F.lit(0.0)) > 0) | (count("retrieved_chunks") > 0))
    long = used.select(F.explode(F.array(*[
        F.struct(F.lit(field).alias("metric"), count(field).cast("double").alias("value"))
        for field in ("retrieved_chunks", "context_chunks", "context_chars")
    ])).alias("m")).select("m.metric", "m.value")
    return linear_percentiles(long, ["metric"], "value", {"median": 0.5})


def slowest(traces: DataFrame, limit: int, value: Column, ties: list[str]) -> DataFrame:
    return traces.orderBy(value.desc(), *ties).limit(limit)
