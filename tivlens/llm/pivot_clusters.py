"""Centroid clustering with exact integer arithmetic and a LAESA pivot table.

Vectors become integers, floor(``scale`` * x). A few fixed pivots are chosen among the first
centroids, and the distance of every vector to every pivot is stored once, beside the vector.
In each round only the centroids' own pivot distances are new: by the triangle inequality
``|d(v, pivot) - d(c, pivot)|`` bounds d(v, c) from below for every centroid, the centroid with the
lowest bound gives a first distance, and only centroids whose bound doesn't exceed it get an
exact one. Bounds are compared with room for rounding, so the nearest centroid always survives.

Each round is one pass over the stored table: tasks add up the components of each cluster, and
Spark sums those partial sums; the driver holds the ``k`` centroids and nothing that grows with
the table. Any number of vectors may fall into one cluster or be equal.

Defined cases: vectors that are null, of another length, or hold null or non-finite components
take no part, and neither do those with a component of 2**27 or more in size after scaling, since
a squared distance would not fit a long; a null id counts as empty text where first centroids are
chosen; rows that repeat an id are vectors of their own (equal hashes in the order of their
components); with fewer than ``k`` vectors there are fewer centroids; an empty table gives no
rows; a centroid without vectors stays where it is; ``inertia`` beyond a long is null. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.common import stored

PIVOTS = 12
LARGEST = 1 << 27  # of a component; 64 squared differences of twice this stay below 2**63
BLOCK = 4096  # vectors compared at once


def quantised(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v array<bigint>`` of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    usable = (F.size("x") == dim) & F.forall("x", lambda x: F.coalesce(
        (x * scale < LARGEST) & (x * scale > -LARGEST) & ~F.isnan(x), F.lit(False)))
    return rows.where(F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order."""
    hashed = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.orderBy(hashed, "v").limit(k).collect()
    return np.array([r.v for r in chosen], np.int64)


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before it."""
    at = [0]
    nearest = squared(points, points[0])
    while len(at) < min(n, len(points)):
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[at[-1]]))
    return points[at]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(squared(points, p).astype(float)) for p in pivots], axis=1)


def nearest(x: np.ndarray, to: np.ndarray, centroids: np.ndarray, centroids_to: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector (with its pivot distances): nearest centroid, squared distance, exact distances computed."""
    bound = np.zeros((len(x), len(centroids)))
    for p in range(to.shape[1]):
        np.maximum(bound, np.abs(to[:, p, None] - centroids_to[None, :, p]), out=bound)
    bound -= 1e-14 * (to.max(initial=0) + centroids_to.max(initial=0)) + 1e-9
    guess = squared(x, centroids[bound.argmin(axis=1)])
    row, col = np.nonzero(bound <= np.sqrt(guess.astype(float))[:, None])
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), BLOCK):
        r, c = row[at:at + BLOCK], col[at:at + BLOCK]
        exact[r, c] = squared(x[r], centroids[c])
    best = exact.argmin(axis=1)  # of equal ones the smallest number
    return best, exact[np.arange(len(x)), best], np.bincount(row, minlength=len(x))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
            yield part, x, part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots)


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v array<int>, to array<double>``: every vector with its distances to the pivots."""
    dim = pivots.shape[1]
    schema = T.StructType([rows.schema["vec_id"], T.StructField("v", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("to", T.ArrayType(T.DoubleType(), False))])

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(x.astype(np.int32)), lists(to_pivots(x, pivots))], names=["vec_id", "v", "to"])

    return rows.mapInArrow(run, schema)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of the vectors nearest to them."""
    k, dim = centroids.shape
    centroids_to = to_pivots(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x, to in _blocks(batches, dim, len(pivots)):
            best = nearest(x, to, centroids, centroids_to)[0]
            np.add.at(sums, best, x)
            n += np.bincount(best, minlength=k)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, dim + 1), pa.int32()), pa.array(np.tile(np.arange(dim + 1), len(at)), pa.int32()),
             pa.array(np.c_[sums[at], n[at]].reshape(-1))], names=["cluster", "place", "total"])

    totals = (table.mapInArrow(run, "cluster int, place int, total bigint").groupBy("cluster", "place")
              .agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect())  # k * (dim + 1) rows at most
    found = {(r.cluster, r.place): int(r.total) for r in totals}
    out = centroids.copy()
    for c in range(k):
        if n := found.get((c, dim)):
            out[c] = [found[c, i] // n for i in range(dim)]
    return out


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance, n_exact`` for every row of the pivot table."""
    centroids_to = to_pivots(centroids, pivots)
    schema = T.StructType([table.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType()), T.StructField("n_exact", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, to in _blocks(batches, centroids.shape[1], len(pivots)):
            best, distance, n = nearest(x, to, centroids, centroids_to)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(best, pa.int32()), pa.array(distance), pa.array(n, pa.int32())],
                names=["vec_id", "cluster", "distance", "n_exact"])

    return table.mapInArrow(run, schema)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, prefix: str = "2:",
                    pivots: int = PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, n_exact, cluster_inertia, inertia, centroid_sha256, centroid`` of every vector that takes part.

    ``n_exact`` is how many exact distances the last assignment needed.
    """
    rows = quantised(vectors, dim, scale, id_col, vec_col)
    centroids = first_centroids(rows, k, prefix)
    facts = ("cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, "
             "centroid array<bigint>")
    if not len(centroids):
        none = vectors.sparkSession.createDataFrame([], facts)
        return rows.select("vec_id", F.lit(0).cast("long").alias("distance"), F.lit(0).alias("n_exact"),
                           F.lit(0).alias("cluster")).join(none, "cluster").select(
            "vec_id", "cluster", "distance", "n_exact", *none.columns[1:])
    fixed = spread(centroids, pivots)
    table = stored(pivot_table(rows, fixed), "pivots")
    for _ in range(rounds):
        centroids = moved(table, centroids, fixed)
    done = stored(assigned(table, centroids, fixed), "assigned")
    sums = {r.cluster: int(r.total) for r in done.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows at most

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    known = vectors.sparkSession.createDataFrame(
        [(c, fits(total), fits(sum(sums.values())),
          hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
         for c, total in sums.items()], facts)
    return done.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
