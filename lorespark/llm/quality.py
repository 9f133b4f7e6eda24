"""Quality: naive Bayes support vectors on n-gram indicators.

Indicators of one to three characters keep their case, for shouting and markup debris show there. They are scaled by the
log-count ratios of the classes, and a hinge-loss model is fitted to them by dual coordinate descent.

Defined results: as for toxicity (null and empty texts get the score of a text without features).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.linear import Model, held_out, train, with_score

ORDERS = (1, 2, 3)
THRESHOLD = 0.5


def train_quality(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels, "quality", ORDERS, fold=False)


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    scored = with_score(docs.select("doc_id", "text"), model, ORDERS, fold=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
