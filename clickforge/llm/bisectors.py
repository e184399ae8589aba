"""Centroid clustering of vectors in whole numbers, by a tournament of bisectors.

A component x becomes the integer floor(1024 * x). For every pair of centroids i < j the bisector's normal 2 (c_j - c_i) and
threshold |c_j|^2 - |c_i|^2 are formed once a round. A vector starts with centroid 0 as winner and meets 1, 2, ... in turn: the
sign of normal . x - threshold says which of both is nearer, zero favours the smaller number. So k - 1 linear
tests find the nearest centroid, and only the winner's distance is computed, exactly.

Scale: the integers are stored once as 32-bit numbers in the shared folder. A round is one scan; a task returns k rows of
sums, which are added up by (cluster, component), so k times 64 numbers reach the driver and k centroids go
back. Sums are decimals of 38 digits and means floor divisions of whole numbers; nothing depends on the order of
rows, retried or not. Products run in floating point only while they stay below 2 ** 53, else in 64-bit integers.

Cases: vectors of another length, null vectors, and vectors with a null or non-finite component are left out; a null id is
kept and hashed as the empty text; equal hashes go by the vectors; fewer than k vectors give fewer centroids; an
empty centroid stays where it is; components beyond ``largest(dim)`` whose distances may not fit 64 bits end the job with an
error that says so; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.functions.arrow import to_matrix
from clickforge.session import materialize

DIM, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
SEED = "3"


def largest(dim: int) -> int:
    """Largest magnitude of a component for which every squared distance fits 64 signed bits."""
    return min(math.isqrt(((1 << 63) - 1) // (4 * dim)), (1 << 31) - 1)


def whole_numbers(vectors: DataFrame, key: str, vec: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, x): the vectors that count, as integers."""
    v, limit = F.col(f"`{vec}`"), largest(dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    numbers = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(F.coalesce((F.size(v) == dim) & finite, F.lit(False))).select(F.col(f"`{key}`").alias("key"), numbers.alias("x"))
    error = F.raise_error(F.lit(f"a component of more than {limit} in magnitude: squared distances may not fit 64 bits"))
    fits = F.forall("x", lambda x: (x >= -limit) & (x <= limit))
    return rows.select("key", F.when(fits, F.col("x").cast("array<int>")).otherwise(error.cast("array<int>")).alias("x"))


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = c = centroids.astype(np.int64)
        squares = (c * c).sum(axis=1)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        self.reach = int(np.abs(c).max(initial=0))

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each integer vector; ties go to the smaller number."""
        reach = max(self.reach, int(np.abs(points).max(initial=0)))
        kind = np.float64 if 4 * points.shape[1] * reach * reach < 1 << 53 else np.int64
        points, normals = points.astype(kind), self.normals.astype(kind)
        winner = np.zeros(len(points), np.int32)
        for challenger in range(1, len(self.centroids)):
            for holder in range(challenger):
                rows = np.flatnonzero(winner == holder)
                if len(rows):
                    nearer = points[rows] @ normals[holder, challenger] > self.thresholds[holder, challenger]
                    winner[rows[nearer]] = challenger
        return winner

    def distance(self, points: np.ndarray, winner: np.ndarray) -> np.ndarray:
        off = points.astype(np.int64) - self.centroids[winner]
        return (off * off).sum(axis=1)


def _sums(rows: DataFrame, sides: Bisectors, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Size and component sums of every non-empty cluster, by number."""
    k = len(sides.centroids)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            points = to_matrix(batch.column(0), dim, np.int64)
            winner = sides.nearest(points)
            count += np.bincount(winner, minlength=k)
            for c in range(k):
                total[c] += points[winner == c].sum(axis=0)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(own.astype(np.int32)), "n": pa.array(count[own]),
            "s": pa.array(list(total[own]), pa.list_(pa.int64())),
        })

    parts = rows.select("x").mapInArrow(add_up, "c int, n long, s array<long>")
    long = parts.select("c", "n", F.posexplode("s").alias("j", "s"))
    found = long.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums: dict[int, list[int]] = defaultdict(lambda: [0] * dim)
    sizes = {}
    for row in found:
        sizes[row["c"]] = row["n"]
        sums[row["c"]][row["j"]] = int(row["s"])
    return {c: (n, sums[c]) for c, n in sizes.items()}


def cluster(
    vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
    dim: int = DIM, scale: int = SCALE, seed: str = SEED,
) -> DataFrame:
    """The key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    rows = materialize(whole_numbers(vectors, key, vec, dim, scale), "whole-vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    starts = rows.orderBy(mark, "x").limit(k).collect()
    centroids = np.array([r["x"] for r in starts], np.int64).reshape(-1, dim)
    for _ in range(rounds if starts else 0):
        for c, (n, total) in _sums(rows, Bisectors(centroids), dim).items():
            centroids[c] = [s // n for s in total]
    sides = Bisectors(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = to_matrix(batch.column(1), dim, np.int64)
            winner = sides.nearest(points)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(winner), pa.array(sides.distance(points, winner))], names=["key", "cluster", "distance"]
            )

    kind = rows.schema["key"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(assign, f"key {kind}, cluster int, distance long"), "clustered")
    inertia = {r[0]: int(r[1]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame(
        [(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row a cluster, at most k
    return placed.join(F.broadcast(known), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
