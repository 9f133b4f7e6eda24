"""Near-duplicate documents: ProbMinHash signatures, banding, verification, classes.

Shingles are runs of five words, weighted by ``1 + ln(count)``. Each shingle is a Poisson process whose rate is its weight;
every arrival falls into one of ``REGISTERS`` registers, and a register keeps the shingle that arrives first. Two documents
agree in a register with a probability equal to the probability Jaccard index of their weighted shingles. A process ends as
soon as its next arrival is later than the latest register, so a long text costs little more than one arrival per shingle.

``BANDS`` bands of ``ROWS`` registers give candidates (a pair at 0.8 shares a band with probability 0.99995). A bucket is never
expanded into all its pairs: first every document meets the least one of its bucket, the verified links are closed into
classes, and then only documents of one bucket that are still in different classes meet, in large buckets by way of their
rarest shingles. So no link of a bucket is lost, and a large group of copies costs one pair per copy and band at most. A link needs a Jaccard index of the shingle sets of
``SIMILARITY`` at least, computed from the whole sets. Texts with equal shingles are one node from the start.

Defined results: a null text is empty; texts without words are equal to each other; a text of fewer than five words is one
shingle; rows that share a ``doc_id`` are one document (it is near another if one of its rows is); a row without ``doc_id``
is not compared and has no class.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import WordHashes, mix, shingle_hashes, texts, words_of, written
from lorespark.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
# Buckets up to this size are paired as they are, larger ones by prefixes of their rarest shingles: the links are the same.
PAIRED_BUCKET = 24
PARITY_WORDS = 16  # 64-bit words of the parities of a shingle set
CHUNK = 200_000  # shingles whose arrivals are drawn together


def shingle_counts(text: str | None, hashes: WordHashes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text, ascending, and their counts."""
    return np.unique(shingle_hashes(hashes.of(words_of(text or "")), width), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` shingle hashes per weighted set (zeros for an empty one)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    signature = np.zeros(len(sets) * registers, dtype=np.uint64)
    if not len(owner):
        return signature.reshape(len(sets), registers)
    item = np.concatenate([s for s, _ in sets])
    weight = 1.0 + np.log(np.concatenate([c for _, c in sets]))
    first = np.full(len(sets) * registers, np.inf)
    arrival, arrivals, step = np.zeros(len(item)), [], 0
    while len(item):
        unit = ((mix(item, 2 * step) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        arrival = arrival - np.log(unit) / weight
        slot = owner * registers + (mix(item, 2 * step + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, arrival)
        arrivals.append((slot, arrival, item))
        latest = first.reshape(len(sets), registers).max(axis=1)
        going = arrival < latest[owner]
        owner, item, weight, arrival, step = owner[going], item[going], weight[going], arrival[going], step + 1
    for slot, when, who in arrivals:
        won = when == first[slot]
        signature[slot[won]] = who[won]
    return signature.reshape(len(sets), registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band and row of ``signature``."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
        for k in range(rows):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k], 17)
    return value.view(np.int64)


def document_signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, two halves of a hash of the weighted shingles, and the band keys of every document."""

    def run(batches):
        hashes = WordHashes()
        for frame in batches:
            held, size, start = [], 0, 0
            for at, text in enumerate(frame["text"]):
                held.append(shingle_counts(text, hashes))
                size += len(held[-1][0])
                if size >= CHUNK or at == len(frame) - 1:
                    digests = [xxhash.xxh3_128_digest(s.tobytes() + c.astype("<i8").tobytes()) for s, c in held]
                    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                    yield pd.DataFrame({
                        "doc_id": frame["doc_id"].iloc[start:at + 1].to_numpy(), "c1": halves[:, 0], "c2": halves[:, 1],
                        "empty": [len(s) == 0 for s, _ in held], "bands": list(band_keys(signatures(held)))})
                    held, size, start = [], 0, at + 1

    return texts(docs).where(F.col("doc_id").isNotNull()).mapInPandas(
        run, "doc_id long, c1 long, c2 long, empty boolean, bands array<long>")


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct shingles (32 bits each, ascending) of the documents in ``nodes``."""

    def run(batches):
        hashes = WordHashes()
        for frame in batches:
            yield pd.DataFrame({"node": frame["doc_id"], "shingles": [
                np.unique((shingle_counts(t, hashes)[0] >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in frame["text"]]})

    return texts(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInPandas(
        run, "node long, shingles array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard index of at least ``similarity``."""

    def run(batches):
        for frame in batches:
            good = []
            for one, other in zip(frame["one"], frame["other"]):
                x, y = np.asarray(one), np.asarray(other)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small < similarity * large:
                    good.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield frame.loc[good, ["a", "b"]]

    sized = sets.select("node", "shingles", F.size("shingles").alias("size"))
    one = sized.select(F.col("node").alias("a"), F.col("shingles").alias("one"), F.col("size").alias("size_a"))
    other = sized.select(F.col("node").alias("b"), F.col("shingles").alias("other"), F.col("size").alias("size_b"))
    # Sets whose sizes differ too much cannot be similar; the condition drops them before the larger payload joins.
    near = (F.col("size_a") >= similarity * F.col("size_b")) & (F.col("size_b") >= similarity * F.col("size_a"))
    met = pairs.join(one, "a").join(other, "b").where(near)
    return met.select("a", "b", "one", "other").mapInPandas(run, "a long, b long").distinct()


def _rarest_first(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``nodes`` in different components that a set similarity join by prefixes cannot rule out.

    Shingles are ordered from the rarest to the most frequent one. Sets this similar share a shingle among the first few of
    both, and what follows its places must be long enough for the overlap. In a group of loose copies of one text the
    rarest shingles are the changed ones, which nobody shares: such copies meet no one, and no pair is lost. A shingle that only
    one of two sets holds flips one bit of its parities, so sets that differ in more bits than similar sets may differ in
    shingles do not meet.
    """
    bits = [f"bits_{k}" for k in range(PARITY_WORDS)]
    items = sets.join(nodes, "node").select("node", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    slot = F.xxhash64("s").bitwiseAND(F.lit(64 * PARITY_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    flipped = items.select("node", "s", slot.alias("slot")).groupBy("node").agg(*[
        F.bit_xor(F.when(F.shiftright("slot", 6) == k, bit).otherwise(F.lit(0).cast("long"))).alias(name) for k, name in enumerate(bits)])
    counts = items.groupBy("s").agg(F.count("*").alias("df"))
    ordered = items.join(counts, "s").groupBy("node", "component", "size").agg(
        F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    prefix = F.slice("o", F.lit(1), (F.col("size") - F.ceil(F.col("size") * similarity) + 1).cast("int"))
    firsts = ordered.select("node", "component", "size", prefix.alias("p"), F.posexplode(prefix).alias("at", "f")).where("f.df > 1").select(
        "node", "component", "size", "at", "f.s", F.transform(F.slice("p", F.lit(1), F.col("at")), lambda x: x["s"]).alias("before"))
    firsts = written(firsts.join(flipped, "node"))
    left, right = (firsts.select("s", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "component", "size", "at", "before", *bits)]) for n in "ab")
    needed = (F.col("size_a") + F.col("size_b")) * (similarity / (1 + similarity)) - 1e-6
    possible = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= needed
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in bits])
    alike = apart <= (F.col("size_a") + F.col("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    # A pair meets once, at its first common shingle.
    first = ~F.arrays_overlap("before_a", "before_b")
    return left.join(right, "s").where("node_a > node_b AND component_a <> component_b").where(possible & alike & first).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id`` and ``class_id`` (the least ``doc_id`` of the class) of every document."""
    signed = written(document_signatures(docs))
    nodes = written(signed.groupBy("c1", "c2").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("empty").alias("empty")))
    members = nodes.where(~F.col("empty")).select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    placed = written(members.join(shared.select("bucket", "leader"), "bucket"))
    sets = written(_shingle_sets(docs, placed.select("node").distinct()))

    met = written(placed.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    links = written(_verified(met, sets, similarity))
    stars = components(links)
    labelled = placed.join(stars.select("node", "component"), "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high")
    rest = written(labelled.join(mixed.select("bucket", "size"), "bucket"))
    small, large = rest.where(F.col("size") <= PAIRED_BUCKET), rest.where(F.col("size") > PAIRED_BUCKET)
    left, right = (small.select("bucket", F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("a", "b"))
    crossed = left.join(right, "bucket").where("a > b AND c_a <> c_b").select("a", "b")
    loose = _rarest_first(large.select("node", "component").distinct(), sets, similarity)
    more = _verified(crossed.unionByName(loose).distinct().join(met, ["a", "b"], "left_anti"), sets, similarity)
    classes = components(links.unionByName(more)).withColumnRenamed("node", "_node")

    return signed.select("doc_id", "c1", "c2").join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).join(
        classes, F.col("node") == F.col("_node"), "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("class_id"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one with the least ``doc_id``. Rows without ``doc_id`` stay."""
    kept = near_duplicates(docs, similarity).where("class_id <> doc_id").select(F.col("doc_id").alias("_dropped"))
    return docs.join(kept, docs["doc_id"] == kept["_dropped"], "left_anti")
