"""Centroids: training, assignment, residuals.

Assignment is by largest inner product, ties to the smaller centroid. A training round is one
pass over the tokens: an Arrow kernel sums each partition's tokens by centroid, so a round shuffles
at most centroids * partitions rows, and the driver sees one row for each centroid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import dot

PRODUCTS = 1 << 21  # held at a time in an assignment, 8 bytes each


def as_matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    flat = np.asarray(column.flatten(), np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


class CoarseQuantizer:
    """Centroids as a matrix on the driver: k * dim numbers, a model and not data.

    Products are in double precision, as in SQL: in single precision centroids that lie close come
    out equal or in the wrong order."""

    def __init__(self, centroids=None):
        self.centroids = np.zeros((0, 0)) if centroids is None else np.asarray(centroids, float)

    @property
    def num_centroids(self) -> int:
        return len(self.centroids)

    def require(self) -> CoarseQuantizer:
        if not self.num_centroids:
            raise RuntimeError("not trained")
        return self

    def assign(self, x: np.ndarray) -> np.ndarray:
        c = self.require().centroids
        step = max(PRODUCTS // len(c), 1)
        own = [np.argmax(x[i : i + step].astype(float) @ c.T, axis=1) for i in range(0, len(x), step)]
        return np.concatenate(own or [[]]).astype(np.int32)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k best centroids of each row, best first."""
        s = np.asarray(x, float) @ self.require().centroids.T
        order = np.argsort(-s, axis=1, kind="stable")[:, : min(k, self.num_centroids)]
        return order, np.take_along_axis(s, order, 1)

    def reconstruct(self, ids) -> np.ndarray:
        return self.require().centroids[np.asarray(ids)]

    def residuals(self, x: np.ndarray) -> np.ndarray:
        return x - self.centroids[self.assign(x)]

    def add(self, more) -> None:
        more = np.asarray(more, float)
        self.centroids = more if not self.num_centroids else np.vstack([self.centroids, more])

    def reset(self) -> None:
        self.centroids = np.zeros((0, 0))


def assign_column(token: str | Column, centroids: list[list[float]]) -> Column:
    """The assignment as a Catalyst expression, for a few centroids."""
    t = F.col(token) if isinstance(token, str) else token
    scored = F.array(*[F.struct(dot(t, F.array(*[F.lit(float(x)) for x in c])).alias("dot"), F.lit(-i).alias("minus")) for i, c in enumerate(centroids)])
    return -F.array_max(scored)["minus"]


def _partial_sums(centroids: np.ndarray):
    def run(batches):
        total, n = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x = as_matrix(b.column(0))
                own = np.argmax(x @ centroids.T, axis=1)
                n += np.bincount(own, minlength=len(centroids))
                np.add.at(total, own, x)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cid", "n", "total"])

    return run


def lloyd_step(tokens: DataFrame, centroids: np.ndarray, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Means of the tokens assigned to each centroid, and how many they are. A centroid without
    tokens stays."""
    dim = centroids.shape[1]
    parts = tokens.select(F.col(column).cast("array<float>")).mapInArrow(_partial_sums(centroids.astype(np.float32)), "cid int, n bigint, total array<double>")
    sums = parts.groupBy("cid").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
    out, count = centroids.astype(np.float32).copy(), np.zeros(len(centroids), np.int64)
    for r in sums.collect():  # one row for each centroid
        out[r["cid"]], count[r["cid"]] = np.asarray(r["total"]) / r["n"], r["n"]
    return out, count


def train_kmeans(tokens: DataFrame, k: int, rounds: int = 10, seed: int = 1234, column: str = "v") -> CoarseQuantizer:
    """Lloyd rounds from k tokens picked by hash. An empty cluster takes its place beside the
    largest."""
    if k <= 0:
        raise ValueError("num_centroids must be positive")
    start = tokens.select(F.col(column).cast("array<float>").alias("v")).orderBy(F.xxhash64("v", F.lit(seed))).limit(k).toArrow().column(0).combine_chunks()
    if not len(start):
        raise ValueError("no tokens to train on")
    c = as_matrix(start)
    if len(c) < k:
        c = np.resize(c, (k, c.shape[1]))
    for _ in range(rounds):
        c, n = lloyd_step(tokens, c, column)
        for empty in np.flatnonzero(n == 0):
            big = int(n.argmax())
            c[empty] = c[big] * np.where(np.arange(c.shape[1]) % 2, 0.999, 1.001).astype(np.float32)
            n[empty] = n[big] = n[big] // 2
    return CoarseQuantizer(c)
