"""Document sources and sinks: JSON pages, Markdown files, questions, traces, vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.functions.text import fold_text
from lorespark.operators import vectors
from lorespark.operators.cleaning import clean_pages, page_header, quality_report, tidy
from lorespark.sources.jsonl import read_trace_lines

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("national_number", T.IntegerType()), T.StructField("page_id", T.LongType()),
    T.StructField("revision_id", T.LongType()), T.StructField("revision_timestamp", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("content", T.StringType()),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file, with the name of its file."""
    rows = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("file_name", F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1))


def new_pages(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Pages whose title is not stored yet, whatever its case."""
    stored = existing.filter(F.length("content") > 0).select(fold_text(F.col("title")).alias("title_key")).distinct()
    return pages.withColumn("title_key", fold_text(F.col("title"))).join(stored, "title_key", "left_anti").drop("title_key")


def markdown_pages(pages: DataFrame) -> DataFrame:
    """Cleaned pages with their header, quality report and status."""
    cleaned = clean_pages(pages)
    header = page_header(
        F.col("title"), F.coalesce("source", F.lit("Poképédia")), F.col("page_id"), F.col("revision_id"),
        F.col("revision_timestamp"), F.col("source_url"))
    final = cleaned.withColumn("cleaned", tidy(F.concat(header, "cleaned")))
    return quality_report(final, "content", "cleaned", "title")


def write_markdown(report: DataFrame, folder: str) -> None:
    """One text file per valid page, under ``file_name=<name>``, through Spark's committed writer into shared storage."""
    valid = report.filter("status <> 'ERROR'").select("file_name", F.col("cleaned").alias("value"))
    valid.repartition("file_name").write.mode("overwrite").partitionBy("file_name").text(folder)


def metadata_value(text: Column, labels: list[str]) -> Column:
    """Value of the first ``label : value`` line found, empty when there is none."""
    values = [F.nullif(F.regexp_extract(text, rf"(?im)^\s*(?:[-*]\s*)?\**{re.escape(label)}\**\s*:\s*(.+?)\s*$", 1), F.lit("")) for label in labels]
    return F.coalesce(*values, F.lit(""))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty Markdown files with their number, slug, title and header values."""
    own = F.regexp_extract("_metadata.file_path", r"/file_name=([^/]+)/[^/]+$", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.when(own != "", F.concat(F.url_decode(own), F.lit(".md"))).otherwise(
            F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)).alias("source_file"),
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    slug = F.when(stem.rlike(r"^\d{4}_.+$"), F.regexp_extract(stem, r"^\d{4}_(.+)$", 1)).otherwise(stem)
    first_heading = F.regexp_extract("text", r"(?m)^\s*# +(\S.*?)\s*$", 1)
    return rows.withColumns({
        "national_number": F.regexp_extract(stem, r"^(\d{4})_", 1).try_cast("int"), "slug": slug,
        "title": F.coalesce(F.nullif(first_heading, F.lit("")), F.initcap(F.trim(F.replace(slug, F.lit("_"), F.lit(" "))))),
        "revision_id": metadata_value(F.col("text"), ["Revision ID", "Révision ID", "revision_id"]),
        "source_url": metadata_value(F.col("text"), ["URL source", "Source URL", "source_url"]),
    })


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One question per line; blank lines and comments are skipped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("question")).filter((F.col("question") != "") & ~F.col("question").startswith("#"))


# ---- traces ------------------------------------------------------------------------

USAGE = ("struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,tokens_per_second:double,"
         "usage_complete:boolean>")
TRACE_SCHEMA = (
    "trace_id string, timestamp timestamp, question string, route string, intent string, router_mode string, router_error string,"
    " pokemon string, single_question boolean, timings map<string,double>,"
    " retrieval struct<retrieved_chunks:int,context_chunks:int,context_chars:int>,"
    f" llm {USAGE}, grounding {USAGE}, retry_llm {USAGE}, retries struct<retrieval:int,generation:int>,"
    " attempts array<struct<step:string,attempt:int,duration_seconds:double,status:string,timings:map<string,double>,error_type:string,"
    "llm:struct<name:string,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>>,"
    " grounding_decision string, total_time double")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a JSONL folder. A broken line, or one of another format, is an error with its file, number and text."""
    return read_trace_lines(spark, path, "graph", TRACE_SCHEMA)


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def attempts_of(traces: DataFrame) -> DataFrame:
    """One row per attempt with its position in the execution and its token usage."""
    rows = traces.select("trace_id", F.posexplode("attempts").alias("position", "a")).select("trace_id", "position", "a.*")
    return rows.select(
        "trace_id", "position", "step", "duration_seconds", "status", "timings", F.col("llm.name").alias("llm_name"),
        "llm.prompt_tokens", "llm.completion_tokens", "llm.total_tokens")


# ---- vector store --------------------------------------------------------------------


def write_vectors(chunks: DataFrame, path: str) -> int:
    """Replace the stored collection and check that every chunk arrived."""
    chunks.write.mode("overwrite").parquet(path)
    stored = chunks.sparkSession.read.parquet(path)
    row = stored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_id").alias("ids")).first()
    if row["n"] != row["ids"]:
        raise ValueError(f"{row['n'] - row['ids']} repeated chunk identifiers in {path}")
    return row["n"]


def with_numbers(chunks: DataFrame) -> DataFrame:
    """Chunks with a numeric ``doc_id``; write the result before using it, so that the numbers stay."""
    return chunks.withColumn("doc_id", F.monotonically_increasing_id())


def rows_digest(df: DataFrame) -> Column:
    """Order-free digest of a multiset of rows, as an aggregate: each repeated row counts again."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    half = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)"))
    return F.concat_ws(":", F.count(F.lit(1)), half(1), half(2))


def export_report(source: DataFrame, exported: DataFrame, doc_id: str = "doc_id", vector: str = "vector", within: float = 1e-4) -> DataFrame:
    """One row: sizes, whether both hold the same multiset of rows, and how many vectors of the export do not find themselves.

    Every vector is a query to an index of the export; a vector is found if a vector of its own row number, or an equal one, is nearest.
    """
    own = exported.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(vector).alias("vector"))
    index = vectors.vector_index(own)
    found = vectors.search_index(index, own.select(F.col("doc_id").alias("query_id"), "vector"), k=1, probes=1, exact=True)
    lost = own.join(found.where(F.col("score") <= within).select(F.col("query_id").alias("doc_id")), "doc_id", "left_anti")
    sizes = source.agg(F.count(F.lit(1)).alias("source_rows"), rows_digest(source).alias("source_digest")).crossJoin(
        exported.agg(F.count(F.lit(1)).alias("exported_rows"), rows_digest(exported).alias("exported_digest")))
    return sizes.select("source_rows", "exported_rows", (F.col("source_digest") == F.col("exported_digest")).alias("same_rows"),
                        lost.agg(F.count(F.lit(1))).scalar().alias("vectors_lost"))


def check_export(source: DataFrame, exported: DataFrame) -> None:
    """Raise unless the export holds the rows of its source and finds each of its vectors."""
    row = export_report(source, exported).first()
    if row["source_rows"] != row["exported_rows"]:
        raise ValueError("the export does not hold every row")
    if not row["same_rows"]:
        raise ValueError("the export holds other rows than its source")
    if row["vectors_lost"]:
        raise ValueError(f"the export does not find {row['vectors_lost']} of its own vectors")
