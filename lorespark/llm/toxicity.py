"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Case is folded; n-grams of four and five characters. The score is a calibrated probability of the label 1.

Defined results: null and empty texts get the score of a text without features (the bias); rows that share a ``doc_id`` are
scored each by itself; without labels of both classes every score is the share of ones. Only ``text`` feeds a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.linear import Model, held_out, train, with_score

ORDERS = (4, 5)
THRESHOLD = 0.7


def train_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels, "toxic", ORDERS, fold=True)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    scored = with_score(docs.select("doc_id", "text"), model, ORDERS, fold=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    # The columns of a document travel in one struct, so none of their names can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return with_score(rows, model, ORDERS, fold=True).where(F.col("score") < THRESHOLD).select("row.*")
