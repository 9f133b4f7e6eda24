"""Incremental reading of the append-only trace folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorespark.operators.traces import step_totals
from lorespark.sources.documents import TRACE_SCHEMA, attempts_of


def trace_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TRACE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def step_total_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, errors and durations per step, kept up to date as traces arrive."""
    return step_totals(attempts_of(trace_stream(spark, folder)), [])


def start_attempt_log(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each new attempt once to a parquet folder; the checkpoint makes a restart resume."""
    rows = attempts_of(trace_stream(spark, folder)).withColumn("read_at", F.current_timestamp())
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
