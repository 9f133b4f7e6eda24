"""Top-k of many queries: the best rows of a block of documents, and the merge of such lists.

Scores of a block are one matrix; only the best ``k`` rows per query leave it, so a (query, document) pair is never a row
of the plan for its own sake.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.ranking import ranked_topk

SCORE_DECIMALS = 6
MERGE_SALTS = 64


class BestRows:
    """Best ``k`` ids per query, by rounded score and then by id."""

    def __init__(self, queries: int, k: int, largest: bool):
        self.k, self.sign = k, 1.0 if largest else -1.0
        self.scores = [np.empty(0) for _ in range(queries)]
        self.ids = [np.empty(0, dtype=np.int64) for _ in range(queries)]

    def add(self, scores: np.ndarray, ids: np.ndarray, eligible: np.ndarray | None = None) -> None:
        """``scores`` has one row per document and one column per query."""
        rounded = np.round(scores, SCORE_DECIMALS) * self.sign
        for q in range(rounded.shape[1]):
            column, own = rounded[:, q], ids
            if eligible is not None:
                column, own = column[eligible[:, q]], ids[eligible[:, q]]
            merged = np.concatenate([self.scores[q], column])
            merged_ids = np.concatenate([self.ids[q], own])
            if len(merged) > self.k:
                # Rows that tie with the last kept score must all stay until ids decide.
                floor = np.partition(merged, len(merged) - self.k)[len(merged) - self.k]
                keep = merged >= floor
                merged, merged_ids = merged[keep], merged_ids[keep]
                order = np.lexsort((merged_ids, -merged))[: self.k]
                merged, merged_ids = merged[order], merged_ids[order]
            self.scores[q], self.ids[q] = merged, merged_ids

    def frame(self, query_ids: list) -> pd.DataFrame:
        counts = [len(ids) for ids in self.ids]
        return pd.DataFrame({
            "query_id": np.repeat(np.asarray(query_ids, dtype=np.int64), counts),
            "doc_id": np.concatenate(self.ids) if self.ids else np.empty(0, dtype=np.int64),
            "score": np.concatenate(self.scores) * self.sign if self.scores else np.empty(0),
        })


SCAN_SCHEMA = "query_id long, doc_id long, score double"


def merge_topk(partial: DataFrame, k: int, largest: bool, rank: str) -> DataFrame:
    """Final ranks from the per-task lists, merged in two steps.

    The first step merges inside slices of the documents, so the last one sees at most
    ``MERGE_SALTS * k`` rows per query however many tasks there were.
    """
    score = F.col("score").desc() if largest else F.col("score").asc()
    order: list[Column] = [score, F.col("doc_id").asc()]
    sliced = partial.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_SALTS)))
    narrowed = ranked_topk(sliced, ["query_id", "slice"], order, k, "slice_rank").drop("slice", "slice_rank")
    return ranked_topk(narrowed, ["query_id"], order, k, rank)
