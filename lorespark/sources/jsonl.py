"""JSON lines with their numbers, and the two trace formats told apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBERED = "file string, split long, number long, line string"
# Keys that make a trace one of the question graph (either will do) or one of the web page (all are there).
GRAPH_KEYS, WEB_KEYS = ["timings", "total_time"], ["outcome", "seconds", "tools"]
WEB_SCHEMA = (
    "trace_id string, timestamp timestamp, model string, server string, question string, outcome string, answer string, error string,"
    " seconds struct<total:double,analysis:double,tools:double,generation:double>,"
    " tokens struct<prompt:bigint,output:bigint,thinking:bigint,output_limit_reached:boolean>,"
    " tools array<struct<name:string,arguments:string,proposed_arguments:string,start:double,seconds:double,result:string>>")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line): every line of the files of a folder, numbered from 1 in its file.

    A task numbers the lines of its splits as it reads them. The number before a split is the sum of the line counts of the earlier
    splits of its file, one row per split; no line is exchanged. A byte order mark at the head of a file is not part of its line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task reads its splits one after the other, so the next number of a split is that of its last line seen.
        reached: dict[tuple[str, int], int] = {}
        for batch in batches:
            files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
            numbers = np.empty(batch.num_rows, dtype=np.int64)
            for row, key in enumerate(zip(files, splits)):
                numbers[row] = reached[key] = reached.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(numbers), batch.column("line")],
                                             names=["file", "split", "number", "line"])

    sizes = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("offset"))
    number = lines.mapInArrow(number, NUMBERED).join(offsets, ["file", "split"])
    return number.select("file", (F.col("number") + F.col("offset")).alias("line_number"), F.regexp_replace("line", "^\\x{FEFF}", "").alias("line"))


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line, kind): ``blank``, ``malformed``, ``not an object``, ``graph``, ``web`` or ``foreign``."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    parsed = numbered_lines(spark, path).withColumn("line", text).withColumn("variant", F.try_parse_json("line"))
    keys = F.json_object_keys("line")
    has = lambda names, every: (F.array_size(F.array_intersect(keys, F.array(*map(F.lit, names)))) >= (len(names) if every else 1))
    kind = F.when(F.col("line") == "", "blank").when(F.col("variant").isNull(), "malformed").when(~F.col("line").startswith("{"), "not an object").when(
        has(GRAPH_KEYS, False), "graph").when(has(WEB_KEYS, True), "web").otherwise("foreign")
    return parsed.select("file", "line_number", "line", kind.alias("kind"))


def read_trace_lines(spark: SparkSession, path: str, kind: str, schema: str, shown: int = 3) -> DataFrame:
    """Traces of one format. Any other line that is not blank is an error with its file and number."""
    lines = trace_lines(spark, path)
    bad = lines.filter(~F.col("kind").isin("blank", kind)).orderBy("file", "line_number").limit(shown).collect()
    if bad:
        raise ValueError("; ".join(f"{row['file']} line {row['line_number']}: {row['kind']}: {row['line'][:120]}" for row in bad))
    return lines.filter(F.col("kind") == kind).select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("t")).select("t.*")


def read_web_traces(spark: SparkSession, path: str) -> DataFrame:
    return read_trace_lines(spark, path, "web", WEB_SCHEMA)
