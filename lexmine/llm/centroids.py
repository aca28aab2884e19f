"""Centroid clustering of integer vectors: a tournament of exact bisector tests names each vector's nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import settle

# Vectors tested at once.
ROWS = 4096


def finite(vec: Column) -> Column:
    """Whether an array of doubles is there and has neither null nor non-finite components."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles as 64-bit integers; numbers beyond 2**62 are refused."""
    found = np.floor(values * scale)
    if found.size and np.abs(found).max() >= 2.0**62:
        raise OverflowError("a component is too large for 64-bit integers")
    return found.astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of `dim` doubles as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Bisectors:
    """For each pair of centroids a < b the plane halfway between them, as an integer normal and threshold.

    |x - b|^2 < |x - a|^2 exactly when x . 2(b - a) > |b|^2 - |a|^2. On the plane the smaller number wins.
    """

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.most = int(np.abs(self.centroids).max(initial=0))
        self.normals = 2 * (self.centroids[None] - self.centroids[:, None])
        squares = (self.centroids**2).sum(1)
        self.thresholds = squares[None] - squares[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest centroid after one test per further centroid, and the squared distance."""
        most = max(self.most, int(np.abs(x).max(initial=0)))
        if 4 * most * most * max(x.shape[1], 1) >= 1 << 62:
            raise OverflowError("squared distances of these vectors do not fit 64-bit integers")
        winner = np.zeros(len(x), np.int64)
        for challenger in range(1, len(self.centroids)):
            side = np.einsum("ij,ij->i", x, self.normals[winner, challenger]) - self.thresholds[winner, challenger]
            winner[side > 0] = challenger
        apart = x - self.centroids[winner]
        return winner, np.einsum("ij,ij->i", apart, apart)


def _sums(rows: DataFrame, model: Bisectors, dim: int, scale: int) -> dict[int, list[int]]:
    """Exact componentwise sums of every non-empty cluster, its number of vectors last."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(model.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 1) for _ in range(k)]
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                x = integers(matrix(batch.column(0).slice(begin, ROWS), dim), scale)
                winner, _ = shared.value.nearest(x)
                for c in np.unique(winner).tolist():
                    mine = x[winner == c]
                    total[c] = [t + s for t, s in zip(total[c], [*mine.sum(0).tolist(), len(mine)])]
        filled = [c for c in range(k) if total[c][-1]]
        sums = pa.array([[Decimal(s) for s in total[c]] for c in filled], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), sums], ["cluster", "sums"])

    parts = rows.select("vec").mapInArrow(run, "cluster int, sums array<decimal(38,0)>")
    added = parts.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("part").alias("total"))
    found: dict[int, list[int]] = {}
    for row in added.orderBy("cluster", "place").collect():  # at most k * (dim + 1) rows
        found.setdefault(row["cluster"], []).append(int(row["total"]))
    return found


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64,
    scale: int = 64, seed: int = 1,
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector of exactly `dim` finite components, and the final centroids.

    A component x counts as the integer floor(scale * x). Centroids start as the k vectors with the smallest SHA-256 of
    "seed:id", in that order; equal hashes (repeated ids) are ordered by their components, and a null id hashes as no
    digits. A round assigns every vector to the nearest centroid and replaces each non-empty one by the floor of the
    mean; all of it is integer arithmetic, so results do not depend on how rows are dealt. Ties go to the smaller number.
    Other rows (null, of another length, with null or non-finite components) are not in the result; repeated rows are
    vectors of their own. With fewer than k vectors each is a centroid; without any the result is empty. The driver
    sees k centroids and their sums only, and k * k normals are broadcast, so k is meant to be at most some hundreds.
    Vectors too large for exact 64-bit arithmetic (components beyond 2**20 with 64 of them) are refused with an error.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).filter((F.size("vec") == dim) & finite(F.col("vec")))
    rows = settle(rows, "rows")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "vec").orderBy("key", "vec").limit(k).collect()
    centroids = integers(np.array([r["vec"] for r in first], np.float64).reshape(-1, dim), scale).tolist()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not centroids:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    for _ in range(rounds):
        for number, sums in _sums(rows, Bisectors(centroids), dim, scale).items():
            centroids[number] = [total // sums[-1] for total in sums[:-1]]
    shared = vectors.sparkSession.sparkContext.broadcast(Bisectors(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                winner, distance = shared.value.nearest(integers(matrix(part.column(1), dim), scale))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(winner.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return settle(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def summary(clusters: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: each vector with its cluster's totals.

    Inertias are summed as decimals; one beyond a long is null.
    """
    totals = {r["cluster"]: int(r["total"]) for r in clusters.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}

    def long(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.array(*[long(totals.get(c, 0)) for c in range(len(centroids))]) if centroids else F.lit(None).cast("array<long>")
    return clusters.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), long(sum(totals.values())).alias("inertia"),
        F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")).alias("centroid_sha256"))
