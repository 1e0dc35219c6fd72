import hashlib
import math

import numpy as np
import pytest

from tivlens.llm.pivot_clusters import cluster_vectors, first_centroids, nearest, quantised, spread, squared, to_pivots


def by_definition(rows, k, rounds, scale=256):
    """All distances, in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    text = lambda i: "" if i is None else str(i)
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{text(r[0])}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), c in zip(kept, to, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def result(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int, v string")


def test_equals_all_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.3).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # many copies of one vector
    rows += [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]  # repeated and missing ids
    df = frame(spark, [(i, v, "clash", 1, None) for i, v in rows])
    found = cluster_vectors(df, k=9, rounds=3, dim=8, pivots=4)
    assert result(found) == by_definition(rows, 9, 3)
    # pivots spare most of the exact distances
    assert found.selectExpr("avg(n_exact) a").first().a < 5


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [1.0, 2.0]), (3, [1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1e300, 0.0]), (10, [0.0, 0.0])]
    df = frame(spark, [(i, v, None, None, "clash") for i, v in rows])
    kept = [r for r in rows if r[0] in (1, 2, 10)]
    assert result(cluster_vectors(df, k=40, dim=2)) == by_definition(kept, 40, 5)  # fewer vectors than centroids
    assert result(cluster_vectors(df, k=1, rounds=2, dim=2)) == by_definition(kept, 1, 2)
    for empty in (df.limit(0), df.where("vec_id = 4")):
        none = cluster_vectors(empty, dim=2)
        assert none.count() == 0 and none.columns == cluster_vectors(df, dim=2).columns


def test_equal_first_centroids_leave_empty_clusters(spark):
    rows = [(i, [0.25, 0.5]) for i in range(30)]
    df = frame(spark, [(i, v, None, None, None) for i, v in rows])
    found = cluster_vectors(df, k=4, dim=2)
    assert result(found) == by_definition(rows, 4, 5)
    assert {r.cluster for r in found.collect()} == {0}


@pytest.mark.parametrize("size", [1.0, 500_000.0])
def test_bounds_never_lose_the_nearest(size):
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 16)) * 256 * size).astype(np.int64)
    cents = x[:30].copy()
    cents[7] = cents[3]  # a tie
    pivots = spread(cents, 6)
    best, d, n = nearest(x, to_pivots(x, pivots), cents, to_pivots(cents, pivots))
    full = np.stack([squared(x, c) for c in cents], axis=1)
    assert (best == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all() and n.max() <= 30


def test_first_centroids_in_hash_order(spark):
    df = frame(spark, [(i, [float(i), 0.0], None, None, None) for i in range(50)])
    order = sorted(range(50), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    got = first_centroids(quantised(df, 2, 256, "vec_id", "embedding"), 5, "2:")
    assert got[:, 0].tolist() == [256 * i for i in order[:5]]
