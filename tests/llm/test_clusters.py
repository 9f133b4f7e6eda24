import hashlib
import math
import random

from lorespark.llm import centroid_filter

SCHEMA = "vec_id long, embedding array<double>, units string, cluster double, leading int"


def frame(spark, rows):
    """Vectors with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, v, "u", 0.5, 1) for i, v in rows], SCHEMA)


def whole(x):
    return int(math.floor(x)) * 1024 if abs(x) >= 2 ** 53 else math.floor(1024 * x)


def brute(rows, k, rounds, dimension):
    """Lloyd rounds over Python integers, every vector against every centroid."""
    kept = [(i, [whole(x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centroids = [list(v) for i, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        labels = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, label) in zip(kept, labels) if label == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    labels, long = assign(), lambda x: x if x < 2 ** 63 else None
    inertia = lambda found: None if any(d >= 2 ** 63 for d in found) else long(sum(found))
    total = inertia([d for d, _ in labels])
    return sorted(((i, n, long(d), inertia([e for e, m in labels if m == n]), total,
                    hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, labels)), key=str)


def found(spark, rows, **options):
    result = centroid_filter.centroid_clusters(frame(spark, rows), **options)
    return sorted((tuple(r)[:6] for r in result.collect()), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(1)
    for spread, number in ((0.01, 120), (1.0, 150), (40.0, 60)):
        rows = [(i, [rng.gauss(5 * (i % 3), spread) for _ in range(6)]) for i in range(number)]
        rows += [(1000 + i, rows[0][1]) for i in range(40)]
        assert found(spark, rows, dimension=6, leading=2, rounds=4) == brute(rows, 8, 4, 6)


def test_ties_go_to_the_smaller_number_and_equal_starts_leave_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(30)]
    got = found(spark, rows, dimension=2, leading=1, rounds=3)
    assert got == brute(rows, 8, 3, 2) and len({r[1] for r in got}) == 2


def test_unusable_rows_repeats_and_very_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random(), rng.random()]) for i in range(12)]
    odd = [(None, [0.5, 0.25]), (3, [0.1, 0.1]), (3, [0.1, 0.1]), (40, None), (41, []), (42, [1.0]), (43, [1.0, None]), (44, [1.0, float("nan")]),
           (45, [float("inf"), 1.0]), (46, [1.0, 2.0, 3.0]), (47, [-0.0, -1e-9])]
    assert found(spark, rows + odd, dimension=2, leading=1, rounds=3) == brute(rows + odd, 8, 3, 2)
    large = rows + [(60, [3e4, -3e4]), (61, [2.0 ** 60, 1.0]), (62, [1e300, -1e300])]
    assert found(spark, large, dimension=2, leading=1, rounds=3) == brute(large, 8, 3, 2)


def test_few_vectors_and_none(spark):
    assert found(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], dimension=2, leading=1) == brute([(1, [1.0, 2.0]), (2, [3.0, 4.0])], 8, 10, 2)
    assert found(spark, [], dimension=2) == []
    assert [r[:3] for r in found(spark, [(None, [1.0, 2.0])], dimension=2)] == []


def test_the_filter_leaves_most_centroids_unmeasured(spark):
    rng = random.Random(3)
    rows = [(i, [10 * (i % 8 == p % 8) + rng.gauss(0, 0.1) for p in range(16)]) for i in range(200)]
    measured = centroid_filter.centroid_clusters(frame(spark, rows), dimension=16, leading=8).agg({"n_measured": "avg"}).first()[0]
    assert measured < 4
