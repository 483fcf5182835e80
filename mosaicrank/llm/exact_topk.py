"""Exact top-k by inner product of integer vectors, with multi-resolution segment statistics.

Each vector is cut into 1, 4 and 16 segments; a resolution keeps the mean and the deviation of
each segment. For a query q and a candidate x, ``sum(len * ((mq - mx)^2 + (sq - sx)^2))`` is at
most their squared distance (Cauchy-Schwarz within a segment), so the inner product
``(|q|^2 + |x|^2 - distance^2) / 2`` is at most ``sum(len * (mq * mx + sq * sx))``. A slot's
candidates pass the resolutions coarse to fine; those whose bound is under the query's k-th best
score so far are out, and the survivors get exact inner products. Bounds get slack for rounding,
so nothing within the k best is ever lost, ties included.

Integers stay exact: doubles where all sums are under 2^53, Python integers otherwise; a score
that no long can hold becomes the nearest long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import SLOT, best_of, clean, search

SEGMENTS = (1, 4, 16)
K = 10
SCALE = 1024
BLOCK = 1024


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations, each times the square root of the segment's length, side by side: the
    inner product of two such rows bounds that of the vectors."""
    edges = np.linspace(0, x.shape[1], min(segments, max(x.shape[1], 1)) + 1).astype(int)
    parts = [x[:, i:j] for i, j in zip(edges, edges[1:], strict=False) if j > i]
    if not parts:
        return np.zeros((len(x), 2))
    root = np.sqrt([p.shape[1] for p in parts])
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1)
    return np.hstack([mean * root, np.stack([p.std(axis=1) for p in parts], axis=1) * root])


class Index:
    """A slot's candidates in blocks, each with its statistics at all resolutions."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable") if len(x) else np.empty(0, int)  # long vectors first
        self.order, self.ids = order, ids
        self.x = x[order]
        self.size = float(np.abs(x).max()) if x.size else 0.0
        self.levels = [segment_statistics(self.x, s) for s in SEGMENTS]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.scored = 0


def answer_queries(index: Index, q_ids: np.ndarray, q: np.ndarray, k: int):
    """Row numbers of queries and candidates and exact scores, at most k for each query."""
    x, n = index.x, len(q)
    reach = float(np.abs(q).max()) if q.size else 0.0
    if index.size * reach * max(x.shape[1], 1) >= 2.0**53:
        return _big(index, q_ids, q, k)
    stats = [segment_statistics(q, s) for s in SEGMENTS]
    slack = 1e-9 * np.sqrt(np.einsum("ij,ij->i", q, q))
    least = np.full(n, -np.inf)
    score = np.full((n, 0), 0.0)
    where = np.zeros((n, 0), np.int64)
    for i in range(0, len(x), BLOCK):
        block = slice(i, i + BLOCK)
        ids = index.ids[index.order[block]]
        tolerance = 1e-6 + slack[:, None] * index.norm[block]
        alive = ids[None, :] != q_ids[:, None]
        for level, mine in zip(index.levels, stats, strict=True):
            some = np.flatnonzero(alive.any(axis=1))
            cols = np.flatnonzero(alive.any(axis=0))
            if not len(some) or not len(cols):
                break
            bound = mine[some] @ level[block][cols].T
            alive[np.ix_(some, cols)] &= bound + tolerance[np.ix_(some, cols)] >= least[some, None]
        a, c = np.nonzero(alive)
        if not len(a):
            continue
        index.scored += len(a)
        now = np.full(alive.shape, -np.inf)
        if len(a) * 4 > alive.size:
            now[a, c] = (q @ x[block].T)[a, c]
        else:
            now[a, c] = np.einsum("ij,ij->i", q[a], x[block][c])
        score = np.hstack([score, now])
        where = np.hstack([where, np.broadcast_to(index.order[block], now.shape)])
        if score.shape[1] > k:  # the k best so far and all that tie with the last
            least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            width = int((score >= least[:, None]).sum(axis=1).max())
            if width < score.shape[1]:
                top = np.argpartition(-score, width - 1, axis=1)[:, :width]
                score, where = np.take_along_axis(score, top, 1), np.take_along_axis(where, top, 1)
    rows, cols, scores = [], [], []
    for i in range(n):
        real = np.flatnonzero(score[i] > -np.inf)
        keep = real[best_of(score[i][real], index.ids[where[i][real]], k)]
        rows.append(np.full(len(keep), i))
        cols.append(where[i][keep])
        scores.append(score[i][keep])
    join = lambda v, t: np.concatenate(v).astype(t) if v else np.empty(0, t)
    return join(rows, np.int64), join(cols, np.int64), join(scores, np.int64)


def _big(index: Index, q_ids: np.ndarray, q: np.ndarray, k: int):
    exact = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    x, limit, out = exact(index.x), 2**63 - 1, []
    for i, row in enumerate(exact(q)):
        score = [max(-limit - 1, min(limit, int(v))) for v in x @ row] if x.shape[1] else [0] * len(x)
        ids = index.ids[index.order]
        keep = sorted((j for j in range(len(x)) if ids[j] != q_ids[i]), key=lambda j: (-score[j], ids[j]))[:k]
        out += [(i, int(index.order[j]), score[j]) for j in keep]
    a = np.array(out, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def exact_topk(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, slot: int = SLOT) -> DataFrame:
    rows = clean(vectors)
    ready = rows.withColumn("v", F.transform("v", lambda x: x * float(scale)))

    def answer(dim):
        return lambda ids, m: Index(ids, np.floor(m)), lambda index, q_ids, m: answer_queries(index, q_ids, np.floor(m), k)

    return search(ready, is_query, k, "long", answer, slot)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
