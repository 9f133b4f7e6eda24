"""Centroid clustering of integer vectors, filtered by PCA-rotated distances.

Components become integers, ``floor(scale * x)``. The principal axes of a sample rotate every vector about the mean of that
sample; a row stores its leading rotated coordinates and the norm of the others (its residual). The projected squared distance of a vector
and a centroid plus the squared difference of their residual norms never exceeds their squared distance. In each round the
centroid of least bound is measured in integers, then every centroid whose bound, less a margin far above the rounding of
doubles, does not exceed that distance. The filter never decides a result: labels, distances and centroids are integers, the
same for any axes and any partitioning. Axes are fitted on at most ``AXES_ROWS`` vectors, those of least hashed ids.

A round is one scan of the written table. A task returns its sums per centroid; ``k`` rows of sums reach the driver, where the
next centroids are exact quotients. Losing an executor costs the scan of its rows.

Defined results: a vector is left out if it is null, has another number of components, or holds a null or a number that is not
finite. Rows that share an id, or equal vectors, are clustered each; start vectors are ordered by hash, then by components. A
row without id is clustered but never a start. With fewer vectors than ``k`` there are fewer centroids, without any the result
is empty. Rows or centroids with very large components are measured by Python integers; a distance or inertia beyond a long is
null. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import written

AXES_ROWS = 4_096
LEADING = 16
TILE_ROWS = 4_096
# Components below this bound keep every squared distance in 2**12 dimensions below 2**63.
SMALL = 1 << 24
MARGIN = 1e-9
# Sums travel in limbs of this base, so that their own sums fit a decimal column.
LIMB = 10 ** 24
SUMS = "cluster int, position int, limb int, total string, n long"
ROTATED = "vec_id long, units array<long>, wide array<double>, leading array<double>, residual double"


def usable(vectors: DataFrame, vector_id: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """(vec_id, units, wide): integer components, or the raw components of a vector with very large ones."""
    x = F.col("_x")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("_x")).where(
        (F.size(x) == dimension) & F.coalesce(finite, F.lit(False)))
    small = F.forall(x, lambda v: F.abs(v) < (SMALL - 1) / scale)
    return kept.select("vec_id", F.when(small, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long"))).alias("units"),
                       F.when(~small, x).alias("wide"))


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 1 << 53 else int(scale * x // 1)


def exact_array(rows: list) -> np.ndarray:
    """Rows of integers as int64 if they are small, else as Python integers."""
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object)


def tiles(batch: pa.RecordBatch, dimension: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the rows of a batch, at most ``TILE_ROWS`` at once."""
    units = batch.column("units")
    plain = units.is_valid().to_numpy(zero_copy_only=False)
    for start in range(0, batch.num_rows, TILE_ROWS):
        rows = start + np.flatnonzero(plain[start:start + TILE_ROWS])
        if len(rows):
            yield rows, units.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dimension)
        rows = start + np.flatnonzero(~plain[start:start + TILE_ROWS])
        if len(rows):
            wide = batch.column("wide").take(pa.array(rows)).to_pylist()
            yield rows, np.array([[_whole(v, scale) for v in row] for row in wide], dtype=object)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to its centroid in the same row, or to one centroid."""
    if vectors.dtype != centroids.dtype:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    gap = vectors - centroids
    return (gap * gap).sum(axis=1)


def principal_axes(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, orthonormal axes by falling variance) of the sample of vectors without very large components."""
    sample = kept.where("units IS NOT NULL").select("units").orderBy(F.xxhash64("vec_id")).limit(AXES_ROWS).collect()
    if not sample:
        return np.zeros(0), np.zeros((0, 0))
    x = np.array([row["units"] for row in sample], dtype=np.float64)
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    return mean, axes[:, ::-1]


def rotate(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates and residual norm of each vector."""
    turned = (vectors.astype(np.float64) - mean) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))


def with_rotation(kept: DataFrame, mean: np.ndarray, axes: np.ndarray, leading: int, dimension: int, scale: int) -> DataFrame:
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coordinates = [None] * batch.num_rows
            residual = [None] * batch.num_rows
            for rows, x in tiles(batch, dimension, scale):
                if x.dtype != object:
                    first, rest = rotate(x, mean, axes, leading)
                    for row, values, norm in zip(rows.tolist(), first, rest.tolist()):
                        coordinates[row], residual[row] = values, norm
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(coordinates, pa.list_(pa.float64())), pa.array(residual, pa.float64())],
                names=["vec_id", "units", "wide", "leading", "residual"])
    return kept.mapInArrow(turn, ROTATED)


def nearest(batch: pa.RecordBatch, centroids: np.ndarray, rotated: tuple, dimension: int, scale: int):
    """(row numbers, vectors, label, exact distance, centroids measured) of the rows of a batch, by tiles."""
    for rows, x in tiles(batch, dimension, scale):
        bound = None
        if x.dtype != object and centroids.dtype != object:
            heads, norms = rotated
            taken = pa.array(rows)
            head = batch.column("leading").take(taken).flatten().to_numpy().reshape(len(rows), -1)
            residual = batch.column("residual").take(taken).to_numpy()
            # The margin covers the rounding of both rotations: some 2**12 ulps of the squared lengths involved.
            lengths = (head ** 2).sum(axis=1)[:, None] + (residual ** 2)[:, None] + (heads ** 2).sum(axis=1) + norms ** 2
            bound = np.zeros((len(rows), len(centroids)))
            for c in range(len(centroids)):
                bound[:, c] = ((head - heads[c]) ** 2).sum(axis=1) + (residual - norms[c]) ** 2
            bound -= MARGIN * lengths + 1
            first = bound.argmin(axis=1)
        else:
            first = np.zeros(len(rows), dtype=np.int64)
        label, distance = first.copy(), squared(x, centroids[first])
        measured = np.ones(len(rows), dtype=np.int32)
        for c in range(len(centroids)):
            open_ = first != c if bound is None else (first != c) & (bound[:, c] <= distance)
            at = np.flatnonzero(open_)
            if len(at):
                found = squared(x[at], centroids[c])
                better = ((found < distance[at]) | ((found == distance[at]) & (c < label[at]))).astype(bool)
                distance[at[better]], label[at[better]] = found[better], c
                measured[at] += 1
        yield rows, x, label, distance, measured


def limbs(value: int) -> Iterator[tuple[int, str]]:
    """(number, signed limb) of a whole number, the lowest first; zero has one limb."""
    sign, rest, number = (-1, -value, 0) if value < 0 else (1, value, 0)
    while rest or not number:
        rest, limb = divmod(rest, LIMB)
        yield number, str(sign * limb)
        number += 1


def _sums(centroids: np.ndarray, rotated: tuple, dimension: int, scale: int) -> Callable:
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * dimension for _ in centroids]
        counts = [0] * len(centroids)
        for batch in batches:
            for _, x, label, _, _ in nearest(batch, centroids, rotated, dimension, scale):
                for c in np.unique(label).tolist():
                    own = x[label == c]
                    counts[c] += len(own)
                    totals[c] = [a + b for a, b in zip(totals[c], own.sum(axis=0).tolist())]
        rows = [(c, p, n, limb, counts[c]) for c, total in enumerate(totals) if counts[c] for p, t in enumerate(total) for n, limb in limbs(t)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))],
            names=["cluster", "position", "limb", "total", "n"])
    return of_task


def start_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the least hashed ids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where("vec_id IS NOT NULL").orderBy(digest, "units", "wide").limit(k).collect()
    return [list(row["units"]) if row["units"] is not None else [_whole(v, scale) for v in row["wide"]] for row in rows]


def centroid_clusters(
    vectors: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", *, k: int = 8, rounds: int = 10, seed: int = 3,
    dimension: int = 64, scale: int = 1024, leading: int = LEADING,
) -> DataFrame:
    """Per vector: cluster, squared distance, inertias, centroid hash, and how many centroids were measured."""
    kept = usable(vectors, vector_id, vector, dimension, scale)
    centroids = start_centroids(kept, k, seed, scale)
    mean, axes = principal_axes(kept)
    rows = written(with_rotation(kept, mean, axes, leading, dimension, scale))

    def state() -> tuple[np.ndarray, tuple | None]:
        exact = exact_array(centroids).reshape(len(centroids), dimension)
        return exact, rotate(exact, mean, axes, leading) if exact.dtype != object and len(mean) else None

    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(*state(), dimension, scale), SUMS) if centroids else None
        found = [] if sums is None else sums.groupBy("cluster", "position", "limb").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        totals, counts = defaultdict(int), {}
        for row in found:
            totals[row["cluster"], row["position"]] += int(row["total"]) * LIMB ** row["limb"]
            if row["limb"] == 0:
                counts[row["cluster"]] = row["n"]
        following = [[totals[c, p] // counts[c] for p in range(dimension)] if c in counts else own for c, own in enumerate(centroids)]
        if following == centroids:
            break  # every further round would return the same centroids
        centroids = following

    exact, rotated = state()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(exact) else ():
            for at, _, labels, distances, measured in nearest(batch, exact, rotated, dimension, scale):
                fitting = [d if d < 1 << 63 else None for d in distances.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(labels, pa.int32()), pa.array(fitting, pa.int64()), pa.array(measured)],
                    names=["vec_id", "cluster", "distance", "n_measured"])

    labelled = written(rows.mapInArrow(label, "vec_id long, cluster int, distance long, n_measured int"))
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per_cluster = {row["cluster"]: row["inertia"] for row in labelled.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    total = None if None in per_cluster.values() else sum(per_cluster.values())
    in_long = lambda value: F.lit(int(value) if value is not None and value < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = lambda values: F.get(F.array(*values), F.col("cluster"))
    if not centroids:
        return labelled.select("vec_id", "cluster", "distance", *[F.lit(None).cast("long").alias(c) for c in ("cluster_inertia", "inertia")],
                               F.lit(None).cast("string").alias("centroid_sha256"), "n_measured")
    return labelled.select(
        "vec_id", "cluster", "distance", of_cluster([in_long(per_cluster.get(c)) for c in range(len(centroids))]).alias("cluster_inertia"),
        in_long(total).alias("inertia"), of_cluster([F.lit(d) for d in digests]).alias("centroid_sha256"), "n_measured")
