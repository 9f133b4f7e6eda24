"""Session helpers: local defaults and readers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(app: str = "lorespark", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs; on a cluster the caller's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LORESPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scalar_of(df: DataFrame, expression: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery column."""
    return df.agg(expression.alias("scalar_value")).scalar()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table whose rows are expensive to process.

    A file with fewer splits than there are cores is dealt over all of them; with at
    least one split per core, the normal case of large data, nothing is moved.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """``df`` by hash of ``keys`` in as many partitions as keep each near ``rows_per_task`` rows, whatever the session's setting.

    An aggregation that holds nearly every row then needs the same memory per task at any size.
    """
    return df.repartition(tasks_for(df, rows_per_task), *keys)


def tasks_for(df: DataFrame, rows_per_task: int) -> int:
    """Number of tasks that take about ``rows_per_task`` rows of ``df`` each, one per core at least."""
    return max(-(-df.count() // rows_per_task), df.sparkSession.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The folder is that of ``spark.checkpoint.dir``. Without it only a local session, where all tasks see one disk, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = tempfile.mkdtemp(prefix="lorespark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lorespark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
