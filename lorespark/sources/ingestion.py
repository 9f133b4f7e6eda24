"""Resumable ingestion of pages: only what changed is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import fold_text
from lorespark.session import written

BUCKETS = 64


@dataclass(frozen=True)
class Ingestion:
    """Pages of one run by what happened to them, and how many partitions were written."""
    new: int
    changed: int
    unchanged: int
    partitions: int


def _stored(pages: DataFrame, folder: str) -> DataFrame | None:
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).exists(path):
        return None
    return pages.sparkSession.read.parquet(folder)


def ingest_pages(pages: DataFrame, folder: str, *, title: str = "title", content: str = "content", revision: str = "revision_id", buckets: int = BUCKETS) -> Ingestion:
    """Add pages to the store in ``folder``; a page is known by its folded title and compared by the digest of its content.

    Title key, digest and bucket stand beside each stored page and serve as the manifest: a run reads those three columns and joins
    them with its pages. Only the buckets of new and changed pages are written again, by partition overwrite, together with
    what else they hold. A run that stops before its overwrite leaves the store as it was, and the next one finds the same
    pages changed. Of pages with one title, the latest revision counts. Pages that a run does not bring stay; a page
    without title has the empty one.
    """
    key = fold_text(F.coalesce(F.col(title), F.lit("")))
    latest = pages.withColumn("title_key", key).groupBy("title_key").agg(F.max_by(F.struct(*pages.columns), F.struct(revision, F.sha2(F.col(content), 256))).alias("page"))
    incoming = latest.select(
        "page.*", "title_key", F.sha2(F.coalesce(F.col(f"page.{content}"), F.lit("")), 256).alias("digest"),
        F.pmod(F.xxhash64("title_key"), F.lit(buckets)).cast("int").alias("bucket"))
    stored = _stored(pages, folder)
    if stored is None:
        incoming = written(incoming)
        row = incoming.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bucket").alias("buckets")).first()
        if row["n"]:
            incoming.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        return Ingestion(row["n"], 0, 0, row["buckets"])
    known = stored.select("title_key", F.col("digest").alias("known_digest"))
    compared = incoming.join(known, "title_key", "left")
    status = F.when(F.col("known_digest").isNull(), "new").when(F.col("known_digest") != F.col("digest"), "changed").otherwise("unchanged")
    compared = written(compared.withColumn("status", status))
    counts = {row["status"]: row["count"] for row in compared.groupBy("status").count().collect()}
    fresh = compared.filter("status <> 'unchanged'")
    touched = fresh.select("bucket").distinct()
    # What the touched buckets keep is read before they are overwritten.
    kept = stored.join(touched, "bucket", "left_semi").join(fresh.select("title_key"), "title_key", "left_anti")
    merged = written(fresh.select(*incoming.columns).unionByName(kept, allowMissingColumns=True))
    partitions = touched.count()
    if partitions:
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return Ingestion(counts.get("new", 0), counts.get("changed", 0), counts.get("unchanged", 0), partitions)
