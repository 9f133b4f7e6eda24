"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Only the number of pieces per length matters to a packing, and there are at most ``capacity`` lengths. So one task counts
nothing but lengths, and the plan is made on that bounded table: pieces above a third of the capacity pair at most twice per
sequence (greedy matching, the largest with the largest that fits), smaller ones go by descending length into the smallest
gap that holds them. A batch of equal pieces takes a run of equal gaps in one step. Every piece then finds its place by its
rank among the pieces of its length. Ranks are counted per (length, salt), so no length is gathered in one task.

Only documents longer than the capacity are cut, into pieces of the full capacity; the first piece takes the remainder.

Defined results: a null text is empty and has the closing id alone; rows that share a ``doc_id`` are packed each by itself
(equal rows take any of their places); an empty table packs into nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lorespark.llm.common import texts, written
from lorespark.llm.tokenizer import VOCABULARY, document_ids

CAPACITY = 1024
# Ranks of equally long pieces are counted in this many salted groups at least, and one per shuffle partition.
SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document: one if it fits, else full pieces after the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    cuts = ([0] if first else []) + list(range(first, length + 1, capacity))
    return list(zip(cuts, cuts[1:]))


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text; ``with_ids`` adds their ids as little-endian unsigned 32-bit numbers."""

    def cut(batches):
        for frame in batches:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                data = np.array(document_ids(text, vocabulary), dtype="<u4")
                for piece, (start, end) in enumerate(piece_bounds(len(data), capacity)):
                    ids = data[start:end].tobytes()
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids)) + ((ids,) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return texts(docs).mapInPandas(cut, PIECES + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each run of equal pieces put into equal gaps of neighbouring sequences."""
    left = {length: n for length, n in counts.items() if n > 0}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, number)
    opened = 0

    def put(length: int, number: int, sequence: int, offset: int) -> None:
        runs.append((length, taken[length], sequence, offset))
        taken[length] += number
        left[length] -= number

    large = sorted(length for length in left if 3 * length > capacity)
    for first in reversed(large):
        while left[first]:
            at = bisect.bisect_right(large, capacity - first) - 1
            while at >= 0 and (large[at] > first or left[large[at]] == 0 or (large[at] == first and left[first] < 2)):
                at -= 1
            if at < 0:
                number = left[first]
                put(first, number, opened, 0)
                gaps[capacity - first].append((opened, number))
            else:
                second = large[at]
                number = left[first] // 2 if second == first else min(left[first], left[second])
                put(first, number, opened, 0)
                put(second, number, opened, first)
                gaps[capacity - first - second].append((opened, number))
            opened += number
    sizes = sorted(g for g in gaps if g and gaps[g])
    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                # No gap is left: open sequences filled with as many of these pieces as fit.
                fits = capacity // length
                number = -(-left[length] // fits)
                sequence, opened = opened, opened + number
                gap, used = capacity, 0
            else:
                gap = sizes[at]
                sequence, number = gaps[gap].pop()
                used = capacity - gap
                if not gaps[gap]:
                    sizes.pop(at)
                fits = gap // length
            # A gap takes more pieces of this length at once while they fit: they would come back to it anyway.
            depth = 0
            while left[length] and depth < fits and number:
                placed = min(number, left[length])
                put(length, placed, sequence, used + depth * length)
                if placed < number:
                    rest = gap - depth * length
                    if rest:
                        if not gaps[rest]:
                            bisect.insort(sizes, rest)
                        gaps[rest].append((sequence + placed, number - placed))
                number, depth = placed, depth + 1
            rest = gap - depth * length
            if rest and number:
                if not gaps[rest]:
                    bisect.insort(sizes, rest)
                gaps[rest].append((sequence, number))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. The input is read twice: give a written table."""
    spark = pieces.sparkSession
    salts = max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At most ``capacity`` rows: one per length.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity))
    keys = np.array([(length << 44) + rank for length, rank, _, _ in runs], dtype=np.int64)
    sequences = np.array([sequence for _, _, sequence, _ in runs], dtype=np.int64)
    offsets = np.array([offset for _, _, _, offset in runs], dtype=np.int64)
    # The plan grows with the capacity, not with the corpus.
    shared = spark.sparkContext.broadcast((keys, sequences, offsets))

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = shared.value
        wanted = (lengths.to_numpy().astype(np.int64) << 44) + ranks.to_numpy()
        at = np.searchsorted(keys, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + wanted - keys[at], "offset": offsets[at]})

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(shifts, ["length", "_salt"])
    placed = ranked.withColumn("_place", F.pandas_udf(place, "sequence_id long, offset long")(
        "length", F.col("_rank") + F.col("_shift")))
    return placed.select(*[c for c in pieces.columns], "_place.sequence_id", "_place.offset")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Place of every piece of every document."""
    return pack(written(document_pieces(docs, capacity, vocabulary, with_ids)), capacity)
