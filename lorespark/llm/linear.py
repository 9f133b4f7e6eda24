"""Hashed n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss fit by dual coordinate descent.

Shared by the toxicity and the quality classifier. Labels are read from the training rows alone; the fit takes at most
``SAMPLE_PER_CLASS`` labelled rows of each class (those with the smallest hashes of their ids), a documented bound: their
feature sets come to the driver. Class totals are counted over all training labels and restore the true class shares.
Scoring covers every row and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import texts

BUCKET_BITS = 18
SAMPLE_PER_CLASS = 1500
SMOOTHING = 10.0  # documents added to the counts of a feature, shared between the classes as they stand
EPOCHS = 8
PENALTY = 1.0


@dataclass
class Model:
    """Weights per bucket (scaled by the ratios), bias and the calibration of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    ratios: np.ndarray


def features(text: str, orders: tuple[int, ...], fold: bool) -> np.ndarray:
    """Distinct buckets of the character n-grams of a whole text."""
    text = text.lower() if fold else text
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    with np.errstate(over="ignore"):
        for n in orders:
            size = len(points) - n + 1
            if size < 1:
                continue
            value = np.full(size, n, dtype=np.uint32)
            for k in range(n):
                value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + points[k:k + size]
            value ^= value >> np.uint32(16)
            value *= np.uint32(0x45D9F3B5)
            found.append(value >> np.uint32(32 - BUCKET_BITS))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed document frequencies of each bucket in the two classes."""
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for buckets, one in zip(rows, label):
        counts[int(one)][buckets] += 1
    ones = label.mean()
    return (np.log((counts[1] + SMOOTHING * ones) / (label.sum() + SMOOTHING))
            - np.log((counts[0] + SMOOTHING * (1 - ones)) / ((1 - label).sum() + SMOOTHING)))


def _vector(buckets: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[buckets]
    return values / max(float(np.sqrt(values @ values)), 1e-9)


def fit_hinge(rows: list[np.ndarray], label: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Support vector machine with hinge loss, solved in the dual one coordinate at a time."""
    vectors = [_vector(buckets, ratios) for buckets in rows]
    sign, dual = 2.0 * label - 1.0, np.zeros(len(rows))
    weights, bias, order = np.zeros(1 << BUCKET_BITS), 0.0, np.random.RandomState(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            x, v = rows[i], vectors[i]
            slack = sign[i] * (v @ weights[x] + bias) - 1.0
            moved = min(max(dual[i] - slack / (v @ v + 1.0), 0.0), PENALTY)
            if moved != dual[i]:
                step = (moved - dual[i]) * sign[i]
                weights[x] += step * v
                bias += step
                dual[i] = moved
    return weights, bias


def calibrate(margin: np.ndarray, label: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins; rows weigh so that the classes have the given shares."""
    ones, zeros = max(label.sum(), 1), max((1 - label).sum(), 1)
    weight = np.where(label == 1, shares[1] / ones, shares[0] / zeros) * len(label)
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * margin).sum() + 1e-3 * slope, g.sum()])
        hessian = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 1e-6)), float(offset)


def fit(rows: list[np.ndarray], label: np.ndarray, totals: tuple[int, int]) -> Model:
    """Model of labelled feature sets; ``totals`` are the counts of both classes over all training labels.

    Without rows of both classes every score is the share of ones among the training labels (one half without any).
    """
    share = (totals[1] + 1) / (sum(totals) + 2)
    if len(rows) < 10 or label.min() == label.max():
        zero = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        return Model(zero, 0.0, 1.0, float(np.log(share / (1 - share))), zero)
    kept = np.arange(len(rows)) % 5 != 0  # every fifth row calibrates and is not fitted
    part = [r for r, k in zip(rows, kept) if k]
    if label[kept].min() == label[kept].max():
        kept[:] = True
        part = rows
    ratios = log_count_ratios(part, label[kept])
    weights, bias = fit_hinge(part, label[kept], ratios)
    aside = np.flatnonzero(~kept) if (~kept).any() and len(set(label[~kept])) == 2 else np.arange(len(rows))
    margin = np.array([_vector(rows[i], ratios) @ weights[rows[i]] + bias for i in aside])
    slope, offset = calibrate(margin, label[aside], (1 - share, share))
    return Model((weights * ratios).astype(np.float32), bias, slope, offset, (ratios * ratios).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str, orders: tuple[int, ...], fold: bool,
          per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model of one label column over a bounded sample of the training rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col(label).cast("int").alias("label"))
    found = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64("doc_id")
    sample = known.where("label = 0").orderBy(key, "doc_id").limit(per_class).unionByName(
        known.where("label = 1").orderBy(key, "doc_id").limit(per_class))

    def extract(batches):
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"],
                                "buckets": [features(t, orders, fold).astype("<u4").tobytes() for t in frame["text"]]})

    # The sample holds at most 2 x per_class rows of (id, label): a proven bound, so it may be broadcast.
    chosen = texts(docs).join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInPandas(extract, "doc_id long, label int, buckets binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["buckets"]))
    order = np.random.RandomState(3).permutation(len(rows))
    rows = [rows[i] for i in order]
    return fit([np.frombuffer(r["buckets"], dtype="<u4") for r in rows], np.array([r["label"] for r in rows], dtype=float),
               (found.get(0, 0), found.get(1, 0)))


def margin_of(model: Model, buckets: np.ndarray) -> float:
    norm = max(float(np.sqrt(model.ratios[buckets].sum(dtype=np.float64))), 1e-9)
    return float(model.weights[buckets].sum(dtype=np.float64)) / norm + model.bias


def with_score(docs: DataFrame, model: Model, orders: tuple[int, ...], fold: bool, name: str = "score") -> DataFrame:
    """``docs`` and the score of every whole text in the column ``name``; no shuffle.

    The model has a fixed size (two arrays of 2**18 floats), whatever the corpus. Other columns pass through untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pd.Series) -> pd.Series:
        model = shared.value
        margin = np.array([margin_of(model, features(t or "", orders, fold)) for t in column], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -60, 60))))

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))
