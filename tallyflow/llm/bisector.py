"""Centroid clustering by a tournament of perpendicular bisectors.

For every pair of centroids i < j the bisector's integer normal 2 (cj - ci) and threshold |cj|^2 - |ci|^2 are computed once a
round. A vector x is nearer to j exactly when x . normal exceeds the threshold; at zero both are as near and the smaller number
stays. Centroids meet in a bracket whose left half always holds the smaller numbers, so k - 1 linear tests leave the nearest one;
no distance is computed before the winner's own. The first half of the tests has the same normals for all vectors and is one
matrix product; all numbers are integers, in doubles only where every sum is below 2^53.

Defined results: vectors that are null, of another length than ``dims`` or with a null, NaN or infinite component are left out.
Null ids are kept and come last when first centroids are chosen; equal ids are ordered by their vectors, and every row counts.
With fewer vectors than centroids every vector starts as one. An empty table gives no rows. Components too large for exact
64-bit distances raise an error. The pairs take k^2 x dims x 8 bytes. Other columns are not read, whatever their names.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tallyflow.llm.frames import name_of
from tallyflow.llm.vectors import first_vectors, integer_digest, integer_sums, integers, means_of, whole_rows


class Bracket:
    """The tournament over ``centroids`` (k x dimensions, integers)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        own = (centroids**2).sum(axis=1)
        self.normals = 2 * (centroids[None] - centroids[:, None])
        self.thresholds = own[None] - own[:, None]
        self.largest = int(np.abs(self.normals).max(initial=0)), int(np.abs(self.thresholds).max(initial=0))
        self.floats = self.normals.astype(np.float64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid of every row of integers."""
        n, d = x.shape
        k = len(self.centroids)
        size = int(np.abs(x).max(initial=0)) * self.largest[0] * d + self.largest[1]
        if size >= 2**63:
            raise ValueError("components too large for exact 64-bit tests")
        normals = self.floats if size < 2**53 else self.normals
        x = x.astype(normals.dtype)
        left = np.arange(0, k - 1, 2)
        beaten = x @ normals[left, left + 1].T > self.thresholds[left, left + 1]
        inside = list((left + beaten).T) + [np.full(n, k - 1)] * (k % 2)
        while len(inside) > 1:
            met = []
            for a, b in zip(inside[::2], inside[1::2]):
                beaten = np.einsum("nd,nd->n", x, normals[a, b]) > self.thresholds[a, b]
                met.append(np.where(beaten, b, a))
            inside = met + inside[len(met) * 2:]
        return inside[0]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and its squared distance."""
        winner = self.nearest(x)
        return winner, ((x - self.centroids[winner]) ** 2).sum(axis=1)


@dataclass
class Clusters:
    """Integer centroids over vectors times ``scale``."""
    centroids: np.ndarray
    scale: float

    def digests(self) -> list[str]:
        return [integer_digest(c) for c in self.centroids]

    def assigner(self):
        """A function from an Arrow column to (kept rows, integers, clusters, squared distances); made once a task."""
        bracket = Bracket(self.centroids)

        def of(column: pa.Array):
            rows, x = whole_rows(column, self.centroids.shape[1])
            x = integers(x, self.scale)
            return rows, x, *bracket.assign(x)

        return of

    def totals(self, df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Component sums, sizes and summed distances of the clusters, over all rows."""
        k, d = self.centroids.shape

        def sums(batch, made=[]):
            made or made.append(self.assigner())
            _, x, winner, d2 = made[0](batch.column(0))
            out = np.zeros((k, d + 2), np.int64)
            for c in range(k):
                mine = winner == c
                out[c, :d], out[c, d], out[c, d + 1] = x[mine].sum(axis=0), mine.sum(), d2[mine].sum()
            return out

        total = integer_sums(df, [vector], sums, (k, d + 2))
        return total[:, :d], total[:, d], total[:, d + 1]


def fit(df: DataFrame, order: Column, vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: float = 256.0) -> Clusters | None:
    """Centroids that start at the first vectors by ``order`` and move to the floor of their means ``rounds`` times. None without vectors."""
    first = first_vectors(df, vector, order, k, dims)
    if not first:
        return None
    model = Clusters(integers(np.array(first), scale), scale)
    for _ in range(rounds):
        sums, sizes, _ = model.totals(df, vector)
        model = Clusters(means_of(sums, sizes, model.centroids.astype(object)).astype(np.int64), scale)
    return model


def predict(df: DataFrame, model: Clusters, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row."""
    _, _, inertia = model.totals(df, vector)
    each, whole, names = [int(v) for v in inertia], int(sum(inertia)), model.digests()
    schema = StructType([StructField("vec_id", df.schema[vec_id].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType()),
                         StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])

    def run(batches):
        of = model.assigner()
        for batch in batches:
            rows, _, winner, d2 = of(batch.column(1))
            if rows.size:
                at = pa.array(winner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), at, pa.array(d2, pa.int64()), pa.array(each, pa.int64()).take(at),
                     pa.array(np.full(len(rows), whole), pa.int64()), pa.array(names, pa.string()).take(at)], names=schema.names)

    return df.select(F.col(name_of(vec_id)), F.col(name_of(vector))).mapInArrow(run, schema)


def clusters(df: DataFrame, order: Column, vector: str = "embedding", vec_id: str = "vec_id", dims: int = 64, **options) -> DataFrame:
    """Fit and predict on the same rows."""
    model = fit(df, order, vector, dims, **options)
    if model is None:
        model = Clusters(np.zeros((1, dims), np.int64), 1.0)
    return predict(df, model, vector, vec_id)
