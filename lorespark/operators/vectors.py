"""Nearest vectors by cosine distance, for many query vectors: an exact scan and an index of cells.

Both sides are packed into blocks, rows of a bounded number of vectors. Blocks of one cell meet by an equality join and a matrix
product ranks each pair of blocks, so neither the corpus nor the queries pass through the driver, and a (query, document) pair is
a row only if it is among the best ``k`` of its pair of blocks.

In the exact scan a cell is a share of the corpus and every query goes to all of them. In the index a cell is the part of space
nearest to a centroid, and a query goes to its ``probes`` nearest cells. An exact search then also visits every cell that the
triangle inequality does not exclude: on unit vectors no member of a cell is nearer than the distance to its centroid less its radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.topk_scan import SCAN_SCHEMA, BestRows, merge_topk
from lorespark.session import written

DEFAULT_CANDIDATES = 100
BLOCK_ROWS, QUERY_ROWS = 2_048, 512
# Centroids are fitted on at most this many vectors (least hashes of ids); their number grows with the root of the corpus up to a bound.
SAMPLE_ROWS, MOST_CELLS, FIT_ROUNDS = 20_000, 1_024, 12
ROUNDING = 2e-6
ZERO_CELL = -1  # vectors of length zero have no direction; every query visits them


def unit_vector(vector: Column) -> Column:
    """The vector scaled to length one, in double precision."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(values, lambda x: x / norm)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(cell, ``name``): the rows (id, vector, scope) of each cell in blocks of about ``size``."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("slices"))
    sliced = rows.join(sizes, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    return sliced.groupBy("cell", "slice").agg(F.collect_list(F.struct("id", "vector", "scope")).alias(name)).drop("slice")


def _ranked_pairs(corpus: DataFrame, queries: DataFrame, k: int, scoped: bool) -> DataFrame:
    """(query_id, doc_id, score): the best ``k`` documents of each query in each pair of blocks of one cell."""
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own, asked = (batch.column(name).slice(row, 1).flatten() for name in ("documents", "queries"))
                eligible = None
                if scoped:
                    scopes = np.asarray(own.field("scope").to_pylist(), dtype=object)
                    eligible = np.stack([scopes == scope for scope in asked.field("scope").to_pylist()], axis=1)
                best = BestRows(len(asked), k, False)
                scores = 1.0 - _unit_rows(_matrix(own.field("vector"))) @ _unit_rows(_matrix(asked.field("vector"))).T
                best.add(scores, own.field("id").to_numpy(), eligible)
                yield pa.RecordBatch.from_pandas(best.frame(asked.field("id").to_pylist()), preserve_index=False)

    pairs = _blocks(corpus, BLOCK_ROWS, "documents").join(_blocks(queries, QUERY_ROWS, "queries"), "cell")
    return pairs.select("documents", "queries").mapInArrow(rank, SCAN_SCHEMA)


def _side(rows: DataFrame, key: str, scope: bool) -> DataFrame:
    """(id, vector, scope); rows without a vector have no distance."""
    return rows.where("vector IS NOT NULL").select(
        F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"),
        (F.col("scope").cast("string") if scope else F.lit(None).cast("string")).alias("scope"))


def nearest(corpus: DataFrame, queries: DataFrame, *, k: int = DEFAULT_CANDIDATES, scope: bool = False, groups: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, vector_rank): ``k`` smallest cosine distances per query, by an exact scan.

    ``corpus`` holds (doc_id, vector[, scope]) and ``queries`` (query_id, vector[, scope]). With ``scope``, only documents of the
    query's scope are ranked. The corpus is dealt to ``groups`` cells (one per shuffle partition), each of which gets all queries.
    """
    groups = groups or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _side(corpus, "doc_id", scope).withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    everywhere = _side(queries, "query_id", scope).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return merge_topk(_ranked_pairs(dealt, everywhere, k, scope), k, False, "vector_rank")


# ---- index of cells --------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """Vectors stored by cell: ``rows`` (id, vector, scope, cell), the unit centroids, and the radius of each cell (negative: empty)."""
    rows: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    scoped: bool


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; the first rows, already in hashed order, are the start."""
    centroids = sample[:cells]
    for _ in range(FIT_ROUNDS if len(centroids) else 0):
        owner = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        empty = np.bincount(owner, minlength=len(centroids)) == 0
        sums[empty] = centroids[empty]
        centroids = _unit_rows(sums)
    return centroids


def vector_index(corpus: DataFrame, *, scope: bool = False, cells: int | None = None) -> VectorIndex:
    """Index of (doc_id, vector[, scope]): centroids of a bounded sample, every vector in the cell of its nearest centroid."""
    rows = _side(corpus, "doc_id", scope)
    sample = rows.select("vector").orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).collect()
    units = _unit_rows(np.array([row["vector"] for row in sample], dtype=np.float64)) if sample else np.zeros((0, 1))
    units = units[(units != 0).any(axis=1)]
    if cells is None:
        cells = int(min(MOST_CELLS, max(1, round(rows.count() ** 0.5 / 2))))
    centroids = _fit(units, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _unit_rows(_matrix(batch.column("vector")))
            likeness = vectors @ centroids.T if len(centroids) else np.zeros((len(vectors), 1))
            zero = (vectors == 0).all(axis=1)
            cell = np.where(zero, ZERO_CELL, likeness.argmax(axis=1)).astype(np.int32)
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * likeness.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=["id", "vector", "scope", "cell", "gap"])

    placed = rows.mapInArrow(place, "id long, vector array<double>, scope string, cell int, gap double")
    stored = written(placed.repartitionByRange(F.col("cell"), F.xxhash64("id")).sortWithinPartitions("cell"))
    radius = np.full(len(centroids) + 1, -1.0)  # the last place is that of the zero cell
    for row in stored.groupBy("cell").agg(F.max("gap").alias("radius")).collect():
        radius[row["cell"]] = row["radius"]
    return VectorIndex(stored.drop("gap"), centroids, radius, scope)


def _away(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors to unit centroids."""
    if not len(centroids):
        return np.zeros((len(vectors), 0))
    return np.sqrt(np.maximum(0.0, 2 - 2 * (vectors @ centroids.T)))


def calibrated_probes(index: VectorIndex, *, k: int = DEFAULT_CANDIDATES, recall: float = 0.95, queries: int = 50) -> int:
    """Fewest probes that reach ``recall`` on average over some stored vectors, against the exact result.

    The cell of each true neighbour has a rank among the cells of its query; the answer is read off these ranks.
    """
    asked = index.rows.orderBy(F.xxhash64(F.lit(1), F.col("id"))).limit(queries).select(F.col("id").alias("query_id"), "vector", "scope")
    true = search_index(index, asked, k=k, exact=True).select("query_id", F.col("doc_id").alias("id"))
    held = true.join(index.rows.select("id", "cell"), "id").where(F.col("cell") != ZERO_CELL).join(asked.select("query_id", "vector"), "query_id").collect()
    if not held:
        return 1
    present = np.flatnonzero(index.radius[:-1] >= 0)
    away = _away(_unit_rows(np.array([row["vector"] for row in held])), index.centroids[present])
    own = away[np.arange(len(held)), np.searchsorted(present, [row["cell"] for row in held])]
    ranks = np.sort((away < own[:, None]).sum(axis=1))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def _visits(queries: DataFrame, index: VectorIndex, probes: int, first: bool) -> DataFrame:
    """(id, vector, scope, cell) of the cells to visit: the nearest ``probes``, or (not ``first``) those beyond that ``bound`` admits."""
    centroids, radius = index.centroids, index.radius
    present = np.flatnonzero(radius[:-1] >= 0)
    held = ["id", "vector", "scope"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _unit_rows(_matrix(batch.column("vector")))
            away = _away(vectors, centroids[present])
            rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
            if first:
                taken = rank < probes
            else:
                least = np.maximum(0.0, away - radius[present]) ** 2 / 2
                bound = batch.column("bound").to_numpy(zero_copy_only=False)[:, None]
                zero = (vectors == 0).all(axis=1)[:, None]
                taken = (rank >= probes) & ((least <= bound + ROUNDING) | zero)
            owner, place = np.nonzero(taken)
            cell = present[place]
            if first and radius[-1] >= 0:
                owner, cell = np.append(owner, np.arange(len(vectors))), np.append(cell, np.full(len(vectors), ZERO_CELL))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name).take(pa.array(owner)) for name in held], pa.array(cell.astype(np.int32))], names=[*held, "cell"])

    return queries.mapInArrow(visit, "id long, vector array<double>, scope string, cell int")


def search_index(
    index: VectorIndex, queries: DataFrame, *, k: int = DEFAULT_CANDIDATES, probes: int = 4, exact: bool = False,
) -> DataFrame:
    """(query_id, doc_id, score, vector_rank) from the ``probes`` nearest cells (see ``calibrated_probes``), or the exact result at more cost.

    The exact search takes the ``k``-th distance of the first visit as a bound. Every cell beyond the first ones whose least
    possible distance is within it is visited too; a query that found fewer than ``k`` documents visits all cells.
    """
    asked = _side(queries, "query_id", index.scoped)
    found = _ranked_pairs(index.rows, _visits(asked, index, probes, True), k, index.scoped)
    if exact and len(index.centroids) > probes:
        found = written(found)
        reached = merge_topk(found, k, False, "vector_rank").where(F.col("vector_rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        bounded = asked.join(reached, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        found = found.unionByName(_ranked_pairs(index.rows, _visits(bounded, index, probes, False), k, index.scoped))
    return merge_topk(found, k, False, "vector_rank")


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): mean vector of each label, aggregated component by component."""
    parts = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("position", "x"))
    means = parts.groupBy("label", "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "x"))), lambda item: item["x"]).alias("vector"))
