"""Cleaning of a training corpus in stages; every stage calls one operator of ``lorespark.llm``.

Toxic documents go, repeated lines go, one document of each near-duplicate group stays, documents that overlap the benchmark
go, and what is left is packed into sequences. Each stage works on all that its predecessor kept. All stages but the last
return the columns of ``documents``.

The defined results for nulls, empty texts, ties and repeated rows are those of the operators. A document all of whose lines
repeat others leaves with the line stage; a document that was empty from the start stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import best_fit, decontamination, line_dedup, probminhash, toxicity
from lorespark.llm.common import documents, written

# SQL has no expression for a trained classifier nor for token ids: tests compare the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of ``docs``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train_toxicity(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return best_fit.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written, read again and given to the next."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
