"""Quality measures: recall, reciprocal rank, accuracies, confusion, golden comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit_rank(cases: DataFrame, results: DataFrame, case: str, expected: list[str], rank: str) -> DataFrame:
    """(case, hit_rank): rank of the first result that carries the expected keys."""
    hits = cases.select(case, *expected).join(results.select(case, *expected, rank), [case, *expected])
    best = hits.groupBy(case).agg(F.min(rank).alias("hit_rank"))
    return cases.select(case).join(best, case, "left")


def recall_and_mrr(ranks: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    hits = [F.avg(F.when(F.col("hit_rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in cutoffs]
    reciprocal = F.avg(F.coalesce(F.lit(1.0) / F.col("hit_rank"), F.lit(0.0))).alias("mrr")
    return ranks.agg(F.count(F.lit(1)).alias("cases"), *hits, reciprocal)


def require_approved(cases: DataFrame, status: str = "status") -> None:
    """Refuse a benchmark that holds unreviewed cases."""
    pending = cases.filter(~F.coalesce(F.col(status) == "APPROVED", F.lit(False))).select("id").limit(10).collect()
    if pending:
        raise ValueError("cases not approved: " + ", ".join(str(row["id"]) for row in pending))


def accuracy(df: DataFrame, expected: Column, found: Column) -> DataFrame:
    """Share of rows whose answer is the expected one; both unknown counts as equal."""
    return df.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count(F.when(expected.eqNullSafe(found), 1)).alias("correct"),
        F.avg(F.when(expected.eqNullSafe(found), 1.0).otherwise(0.0)).alias("accuracy"),
    )


def confusion(df: DataFrame, expected: str, found: str) -> DataFrame:
    return df.groupBy(expected, found).agg(F.count(F.lit(1)).alias("n"))


def same_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that differ between two row lists, with the side and the number in excess.

    Lists are compared without order, repeats counted: both sides are counted per value
    before they meet, so equal rows never pair up.
    """
    columns = left.columns
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    condition = F.lit(True)
    a, b = count(left, "n_left").alias("a"), count(right.select(*columns), "n_right").alias("b")
    for column in columns:
        condition = condition & F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))
    joined = a.join(b, condition, "full")
    excess = F.coalesce("n_left", F.lit(0)) - F.coalesce("n_right", F.lit(0))
    return joined.select(
        *[F.coalesce(F.col(f"a.{column}"), F.col(f"b.{column}")).alias(column) for column in columns], excess.alias("excess")
    ).filter("excess <> 0")


REVIEW_FIELDS = ["factually_correct", "complete", "unsupported_claims", "abstained", "abstention_appropriate"]


def review_summary(cases: DataFrame) -> DataFrame:
    """Totals of a human review; unread cases stay out, half-read ones are an error."""
    unread = F.lit(True)
    full = F.trim(F.coalesce(F.col("review.reviewer"), F.lit(""))) != ""
    for field in REVIEW_FIELDS:
        unread = unread & F.col(f"review.{field}").isNull()
        full = full & F.col(f"review.{field}").isNotNull()
    marked = cases.withColumn("reviewed", ~unread).withColumn("broken", ~unread & ~full)
    repeated = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise ValueError("duplicate case identifiers")
    broken = marked.filter("broken").select("id").limit(10).collect()
    if broken:
        raise ValueError("incomplete review: " + ", ".join(str(row["id"]) for row in broken))
    answered = F.col("reviewed") & ~F.col("review.abstained")
    abstained = F.col("reviewed") & F.col("review.abstained")
    count = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    return marked.agg(
        F.count(F.lit(1)).alias("total"), count(F.col("reviewed"), "reviewed"), count(~F.col("reviewed"), "pending"),
        count(answered, "answered"), count(answered & F.col("review.factually_correct"), "factually_correct"),
        count(answered & F.col("review.complete"), "complete"),
        count(answered & F.col("review.unsupported_claims"), "with_unsupported_claims"),
        count(abstained, "abstained"), count(abstained & F.col("review.abstention_appropriate"), "appropriate_abstentions"),
    )
