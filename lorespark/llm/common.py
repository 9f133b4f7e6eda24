"""What several corpus operators share: input columns, shared scratch tables, word hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.session import written  # noqa: F401

WORD = re.compile(r"\w+")
# Words remembered per Python worker; a memory bound only, forgotten words are hashed again.
CACHED_WORDS = 400_000


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text read as empty; other columns cannot clash with an operator's own."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str) -> list[str]:
    """Words of a text in lower case: runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def mix(values: np.ndarray, seed: int) -> np.ndarray:
    """Bijective 64-bit mixing (the finaliser of splitmix64) of ``values`` moved by ``seed``."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter non-empty text is one shingle, an empty one has none."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        value = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            value = value * np.uint64(0x100000001B3) + words[k:k + n]
            value ^= value >> np.uint64(29)
    return mix(value, width)
