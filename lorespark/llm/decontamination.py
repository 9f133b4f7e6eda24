"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: the hash of a place covers the words under the ones and ignores the others, so
a changed word between them does not hide a match. Every place of every text is hashed under every mask. A Bloom filter of the
benchmark's hashes (a fixed size) drops the places that cannot match inside the task that read them; what is left meets the
benchmark in an equality join on (mask, hash). Each hit names a diagonal, a shift between a document and an item. Along it
the words are compared one by one: an overlap counts if a run with at least four equal words in five has ``LEAST`` equal
words, or if four in five words of the whole item are equal.

The masks leave no such overlap without a hit. Any two of ten neighbouring words lie under the zeros of one of ``MASKS``, so ten
words with at most two changed ones have a hit, and every overlap of an item of ten words or more has such ten words (twelve
equal words of a run come before its third unequal one; in a whole item of q >= 2 disjoint tens at most 2 q + 1 words differ), but
for items of 15 to 17 words with three changed ones in the middle that all their tens share: there the words before and
behind are a mask of their own. Items of fewer than ten words allow one changed word and are cut into three parts, of which
two stand unchanged. Seeds may reach over the ends of a document; words that are missing there count as changed.

Words are compared in lower case without punctuation. Items of fewer than ``SHORTEST`` words are no evidence and match nothing.

Defined results: null and empty texts and items match nothing; equal items each match; rows that share a ``doc_id`` are one
document (the best overlap counts); a row without ``doc_id`` is reported under a null id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import WordHashes, mix, texts, words_of, written

MASKS = ("0010111100", "1001001011", "0011000111", "1110001100", "1100110010", "0101110001")
WIDEST = 17  # words of the longest mask
SHORTEST = 5
LEAST = 12
SHARE = 0.8
BLOOM_BITS = 24  # a filter of 2**24 bits, 2 MB, whatever the benchmark; a full one only filters less
CHUNK = 200_000  # words hashed together


def masked_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the words under the ones of ``mask`` at every place where the whole mask fits."""
    n = len(words) - len(mask) + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    value = np.full(n, number + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n]
    return mix(value, number)


def item_masks(lengths: list[int]) -> list[str]:
    """Masks for the item lengths that ``MASKS`` do not cover; they span whole items."""
    masks = []
    for n in sorted(set(lengths)):
        if SHORTEST <= n < len(MASKS[0]):
            cuts = [0, (n + 2) // 3, (n + 2) // 3 + (n + 1) // 3, n]
            masks += ["".join("0" if cuts[k] <= at < cuts[k + 1] else "1" for at in range(n)) for k in range(3)]
        elif 15 <= n <= WIDEST:
            masks.append("1" * (n - 10) + "0" * (20 - n) + "1" * (n - 10))
    return masks


def _bloom_places(values: np.ndarray) -> list[np.ndarray]:
    low = np.uint64((1 << BLOOM_BITS) - 1)
    return [((values >> np.uint64(shift)) & low).astype(np.int64) for shift in (0, 20, 40)]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item_id`` and the word hashes (32 bits) of each item that is long enough."""

    def run(batches):
        hashes = WordHashes()
        for frame in batches:
            words = [hashes.of(words_of(t or "")).view(np.int64) for t in frame["text"]]
            kept = [len(w) >= SHORTEST for w in words]
            yield pd.DataFrame({"item_id": frame["item_id"][kept], "item": pd.Series([w for w, k in zip(words, kept) if k], dtype=object).to_numpy()})

    return benchmark.select("item_id", "text").mapInPandas(run, "item_id long, item array<long>")


def item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """``mask``, ``hash``, ``item_id`` and place of every seed of every item."""

    def run(batches):
        for frame in batches:
            for item_id, words in zip(frame["item_id"], frame["item"]):
                words = np.asarray(words).view(np.uint64)
                for number, mask in enumerate(masks):
                    if number < len(MASKS) or len(mask) == len(words):
                        found = masked_hashes(words, mask, number).view(np.int64)
                        yield pd.DataFrame({"mask": number, "hash": found, "item_id": item_id, "item_at": np.arange(len(found))})

    return items.mapInPandas(run, "mask int, hash long, item_id long, item_at int")


def bloom_filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter of all seed hashes: at most 2**BLOOM_BITS / 64 words come to the driver."""
    low = (1 << BLOOM_BITS) - 1
    places = F.explode(F.array(*[F.expr(f"shiftrightunsigned(hash, {shift}) & {low}L") for shift in (0, 20, 40)]))
    words = seeds.select("hash").distinct().select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).collect()
    filled = np.zeros((1 << BLOOM_BITS) >> 6, dtype=np.int64)
    for row in words:
        filled[row["w"]] = row["bits"]
    return filled.view(np.uint64)


def document_hits(docs: DataFrame, masks: list[str], bloom: np.ndarray) -> DataFrame:
    """Documents with places that pass the filter: their words and ``hits`` (mask, place, hash)."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def passing(values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        for place in range(3):
            p = _bloom_places(values[at])[place]
            at = at[(shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return at

    def run(batches):
        hashes, gap = WordHashes(), np.zeros(WIDEST, dtype=np.uint64)
        for frame in batches:
            held, size, first = [], 0, 0
            for at, text in enumerate(frame["text"]):
                held.append(hashes.of(words_of(text)))
                size += len(held[-1])
                if size < CHUNK and at < len(frame) - 1:
                    continue
                starts = len(gap) + np.cumsum([0] + [len(w) + len(gap) for w in held])
                words = np.concatenate([gap, *[part for w in held for part in (w, gap)]])
                hits: list[list] = [[] for _ in held]
                for number, mask in enumerate(masks):
                    values = masked_hashes(words, mask, number)
                    for place in passing(values):
                        # A mask is no longer than a gap: it touches the words of one document at most.
                        owner = int(np.searchsorted(starts, place + len(mask) - 1, side="right")) - 1
                        inside = int(place - starts[owner])
                        if owner >= 0 and inside < len(held[owner]):
                            hits[owner].append({"mask": number, "at": inside, "hash": int(values[place].view(np.int64))})
                kept = [k for k, h in enumerate(hits) if h]
                if kept:
                    part = frame.iloc[[first + k for k in kept]]
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "row_key": part["row_key"].to_numpy(),
                                        "words": [held[k].view(np.int64) for k in kept], "hits": [hits[k] for k in kept]})
                held, size, first = [], 0, at + 1

    keyed = texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return keyed.mapInPandas(run, "doc_id long, row_key long, words array<long>, hits array<struct<mask:int,at:int,hash:long>>")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, equal words of the best diagonal, of its best run, and words of the item, per verified overlap."""
    items = written(benchmark_items(benchmark))
    # At most one number per length up to the longest mask's: a fixed size.
    lengths = items.select(F.size("item").alias("n")).where(F.col("n") <= WIDEST).distinct().collect()
    masks = [*MASKS, *item_masks([r["n"] for r in lengths])]
    seeds = written(item_seeds(items, masks))
    found = written(document_hits(docs, masks, bloom_filter(seeds)))
    hits = found.select("doc_id", "row_key", F.explode("hits").alias("hit")).select(
        "doc_id", "row_key", "hit.mask", "hit.hash", "hit.at")
    diagonals = hits.join(seeds, ["mask", "hash"]).select(
        "row_key", F.col("doc_id").alias("_id"), "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    met = diagonals.join(found.select("row_key", "doc_id", "words"), "row_key").where(F.col("doc_id").eqNullSafe(F.col("_id"))).join(items, "item_id")

    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item"), F.size("words") - F.col("shift"))
    equal = F.zip_with(F.slice("words", F.col("shift") + low + 1, high - low), F.slice("item", low + 1, high - low), lambda x, y: x == y)
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("total"))

    def walk(s, same):
        run = F.when(s["score"] > 0, s["run"]).otherwise(0) + F.when(same, 1).otherwise(0)
        # One unequal word outweighs four equal ones: a run with a positive score has four equal words in five.
        score = F.when(s["score"] > 0, s["score"]).otherwise(0) + F.when(same, 1).otherwise(-4)
        return F.struct(score.alias("score"), run.alias("run"), F.when(same, F.greatest(s["best"], run)).otherwise(s["best"]).alias("best"),
                        (s["total"] + F.when(same, 1).otherwise(0)).alias("total"))

    scored = met.select("doc_id", "item_id", F.size("item").alias("item_words"), F.aggregate(equal, start, walk).alias("o"))
    good = (F.col("o.best") >= F.least(F.lit(LEAST), F.col("item_words"))) | (F.col("o.total") >= SHARE * F.col("item_words"))
    return scored.where(good).groupBy("doc_id", "item_id", "item_words").agg(
        F.max("o.total").alias("equal_words"), F.max("o.best").alias("longest_run"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item."""
    hit = overlaps(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")
