"""Registered queries of trace files, streams and page ingestion, written from driver tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import traces
from lorespark.session import scratch_path, table, wide_table
from lorespark.sources import jsonl
from lorespark.sources.ingestion import ingest_pages
from lorespark.streaming.attempts import NUMBERED, run_attempt_numbers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


@query("trace_line_numbers", """
WITH l AS (SELECT user_id % 4 AS folder, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS line_number,
    CASE event_id % 7 WHEN 0 THEN 'blank' WHEN 1 THEN 'malformed' WHEN 2 THEN 'web' WHEN 3 THEN 'not an object' WHEN 4 THEN 'foreign' ELSE 'graph' END AS kind FROM events)
SELECT folder, line_number, kind FROM l""")
def trace_line_numbers(spark, sf):
    """Events written as trace files of both formats, with bad, foreign and blank lines between them."""
    events = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("folder"), "event_type", "value")
    rest = F.col("event_id") % 7
    graph = F.to_json(F.struct(F.col("event_id").alias("trace_id"), F.col("event_type").alias("question"), F.col("value").alias("total_time")))
    web = F.to_json(F.struct(F.col("event_id").alias("trace_id"), F.lit("answered").alias("outcome"), F.struct(F.col("value").alias("total")).alias("seconds"), F.array().cast("array<string>").alias("tools")))
    line = F.when(rest == 0, "  ").when(rest == 1, '{"trace_id": ').when(rest == 2, web).when(rest == 3, "[1, 2]").when(rest == 4, '{"x": 1}').otherwise(graph)
    path = scratch_path(spark)
    events.select("folder", "event_id", line.alias("value")).repartition(4, "folder").sortWithinPartitions("folder", "event_id").select("folder", "value").write.partitionBy(
        "folder").text(path)
    found = jsonl.trace_lines(spark, path)
    return found.select(F.regexp_extract("file", r"folder=(\d+)", 1).cast("long").alias("folder"), "line_number", "kind")


def _streamed(spark, sf):
    """Events in two halves, the later one after a restart of the stream."""
    events = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("trace"), F.col("event_type").alias("step"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    root = scratch_path(spark)
    # Events without a time come last.
    early = F.coalesce(F.col("ts") < F.lit(middle), F.lit(False))
    for half in (early, ~early):
        events.filter(half).write.mode("append").parquet(f"{root}/events")
        # All files of a half are one batch: inside it events are put in order, whatever file holds them.
        run_attempt_numbers(spark, f"{root}/events", f"{root}/numbered", f"{root}/checkpoint", "click", "view", files_per_batch=1_000_000)
    return spark.read.schema(NUMBERED).parquet(f"{root}/numbered")


@query("streamed_attempt_numbers", """
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events""")
def streamed_attempt_numbers(spark, sf):
    return _streamed(spark, sf).select("event_id", F.col("trace").alias("user_id"), F.col("step").alias("event_type"), "attempt")


@query("streamed_call_matches", """
WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click'),
r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view')
SELECT user_id, c.event_id AS call_id, r.event_id AS response_id FROM c JOIN r USING (user_id, n)""")
def streamed_call_matches(spark, sf):
    """Calls with their responses, first in first out; calls still without one stay in the state of the stream."""
    return _streamed(spark, sf).filter("call_id IS NOT NULL").select(F.col("trace").alias("user_id"), "call_id", "response_id")


@query("page_ingestion", """
SELECT 1 AS run, count(*) AS new, 0::BIGINT AS changed, 0::BIGINT AS unchanged, true AS complete FROM pages UNION ALL
SELECT 2, 0, 0, count(*), true FROM pages UNION ALL
SELECT 3, 0, count(*) FILTER (page_id % 10 = 3), count(*) FILTER (page_id % 10 <> 3), true FROM pages""")
def page_ingestion(spark, sf):
    """All pages three times: as they are, again, and with every tenth one edited; the store must hold the last state."""
    pages = wide_table(spark, sf, "pages").select(F.concat(F.lit("Page "), "page_id").alias("title"), F.col("html").alias("content"), "page_id", F.lit(1).alias("revision_id"))
    edited = pages.withColumn("content", F.when(F.col("page_id") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("revision_id", F.lit(2))
    folder, rows = scratch_path(spark), []
    digest = lambda df: df.select("page_id", F.sha2("content", 256).alias("d"))
    for run, state in enumerate((pages, pages, edited), 1):
        done = ingest_pages(state, folder)
        stored = spark.read.parquet(folder)
        complete = digest(state).exceptAll(digest(stored)).isEmpty() and digest(stored).exceptAll(digest(state)).isEmpty()
        rows.append((run, done.new, done.changed, done.unchanged, complete))
    return spark.createDataFrame(rows, "run int, new long, changed long, unchanged long, complete boolean")


@query("trace_usage_distribution", """
WITH e AS (SELECT event_id, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
u AS (SELECT k * 2 AS p, k AS c, k * 3 AS t, value AS r FROM e WHERE event_id % 9 <> 0 AND event_id % 4 <> 1 AND k > 0 AND value > 0),
v AS (SELECT 'prompt_tokens' AS metric, p::DOUBLE AS v FROM u UNION ALL SELECT 'completion_tokens', c FROM u UNION ALL SELECT 'total_tokens', t FROM u UNION ALL SELECT 'tokens_per_second', r FROM u)
SELECT metric, count(*) AS count, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.95), 5) AS p95 FROM v GROUP BY metric""")
def trace_usage_distribution(spark, sf):
    """Events as model calls: one in nine has no usage, one in four an incomplete one."""
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.struct((k * 2).alias("prompt_tokens"), k.alias("completion_tokens"), (k * 3).alias("total_tokens"),
                     F.col("value").alias("tokens_per_second"), (F.col("event_id") % 4 != 1).alias("usage_complete"))
    calls = table(spark, sf, "events").select(F.when(F.col("event_id") % 9 != 0, usage).alias("llm"))
    rows = traces.usage_distribution(calls, "llm")
    return rows.select("metric", "count", *[F.round(c, 5).alias(c) for c in ("mean", "median", "p95")])


@query("trace_retrieval_medians", """
WITH e AS (SELECT event_id % 12 AS r, event_id % 5 AS c, value FROM events WHERE event_id % 12 > 0 OR event_id % 3 = 0)
SELECT 'retrieved_chunks' AS metric, median(r)::DOUBLE AS median FROM e UNION ALL SELECT 'context_chunks', median(c) FROM e UNION ALL SELECT 'context_chars', round(median(floor(value)), 6) FROM e""")
def trace_retrieval_medians(spark, sf):
    """Events as traces that retrieved something: some by their count of chunks, some by the time they spent."""
    event = F.col("event_id")
    retrieval = F.struct((event % 12).alias("retrieved_chunks"), (event % 5).alias("context_chunks"), F.floor("value").alias("context_chars"))
    rows = table(spark, sf, "events").select(retrieval.alias("retrieval"), F.create_map(F.lit("retrieval"), F.when(event % 3 == 0, 1.0).otherwise(0.0)).alias("timings"))
    return traces.retrieval_medians(rows).select("metric", F.round("median", 6).alias("median"))
