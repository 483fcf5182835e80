"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is approximated by the sum of one codeword from each of CODEBOOKS full-dimensional
codebooks. Training starts from k-means on successive residuals of a bounded sample (SAMPLE rows,
those with the smallest hashes), then alternates beam-search encoding with an update of each
codebook against what the others leave. Every row is encoded, by a beam search of BEAM partial codes, with the norms of
itself and of its approximation stored. A query's table of inner products with all codewords
gives scores by lookups; the RERANK best of each slot then get exact inner products in double
precision, and the best of those are returned. Equal vectors of a slot are one candidate in this,
so that none of them takes the place of another; after the cut they stand for their rows.

Zero vectors take no part either. Every row is indexed and every query meets every slot, so a
result can only miss a neighbour that the lookups rank under RERANK distinct vectors of its slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .vectors import SLOT, best_of, clean, matrix, search

CODEBOOKS = 16
CODEWORDS = 256
SAMPLE = 8192
BEAM = 4
RERANK = 256
K = 20


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, chunk: int = 512) -> np.ndarray:
    """Codes (rows, codebooks): the best of a beam of partial codes, codebook after codebook."""
    m, k, d = books.shape
    norm = np.einsum("mkd,mkd->mk", books, books)
    out = np.empty((len(x), m), np.uint8)
    for i in range(0, len(x), chunk):
        rest, codes = x[i : i + chunk, None, :], np.empty((len(x[i : i + chunk]), 1, 0), np.uint8)
        error = np.einsum("nbd,nbd->nb", rest, rest)
        for j in range(m):
            now = error[:, :, None] - 2 * (rest @ books[j].T) + norm[j]
            flat = now.reshape(len(rest), -1)
            width = min(beam if j < m - 1 else 1, flat.shape[1])
            top = np.argpartition(flat, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(flat, top, 1)
            parent, word = top // k, top % k
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        out[i : i + chunk] = codes[np.arange(len(rest)), error.argmin(axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books))) if len(books) else np.zeros((len(codes), 0))


def train(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 1, seed: int = 5) -> np.ndarray:
    """Codebooks (codebooks, codewords, dim) from a sample of rows."""
    rng, rest, books = np.random.default_rng(seed), x.copy(), []
    for _ in range(codebooks):
        books.append(_kmeans(rest, codewords, rng))
        own = np.argmax(rest @ books[-1].T - 0.5 * np.einsum("ij,ij->i", books[-1], books[-1]), axis=1)
        rest -= books[-1][own]
    books = np.stack(books)
    for _ in range(rounds):
        codes = encode(x, books)
        rest = x - decode(codes, books)
        for j in range(codebooks):  # each codeword becomes the mean of what the others leave
            rest += books[j][codes[:, j]]
            n = np.bincount(codes[:, j], minlength=codewords)
            total = np.zeros_like(books[j])
            np.add.at(total, codes[:, j], rest)
            books[j][n > 0] = total[n > 0] / n[n > 0, None]
            rest -= books[j][codes[:, j]]
    return books


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one row of each distinct vector, and for each row the number of its vector."""
    if not x.shape[1]:
        return np.zeros(min(len(x), 1), np.int64), np.zeros(len(x), np.int64)
    whole = np.ascontiguousarray(x + 0.0).view(f"V{x.shape[1] * x.itemsize}").ravel()  # no negative zeros
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    return first, of


class Index:
    """A slot's candidates: the distinct vectors with codes and stored norms, and the rows of each
    by rising id (rows order[start[i] : start[i + 1]] have vector i)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, books: np.ndarray):
        first, of = distinct(x)
        self.ids, self.x = ids, (x := x[first])
        self.order = np.lexsort((ids, of))
        self.sorted = ids[self.order]
        self.start = np.searchsorted(of[self.order], np.arange(len(x) + 1))
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = (x / self.norm[:, None]).astype(np.float32)  # directions are coded, lengths stored
        self.codes = encode(unit, books)
        near = decode(self.codes, books)
        self.scale = (self.norm / np.maximum(np.sqrt(np.einsum("ij,ij->i", near, near)), 1e-12)).astype(np.float32)

    def rows_of(self, some: np.ndarray, but: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the vectors some and other ids than but, the k smallest ids of each, and for
        each row the place of its vector in some."""
        start, n = self.start[some], self.start[some + 1] - self.start[some]
        single = np.flatnonzero((n == 1) & (self.sorted[start] != but))
        rows, at = [self.order[start[single]]], [single]
        for i in np.flatnonzero(n > 1).tolist():
            a, z = start[i], start[i] + n[i]
            own = self.sorted[a:z]  # those of but lie together
            lo, hi = np.searchsorted(own, but), np.searchsorted(own, but, "right")
            rows += [self.order[a : a + min(lo, k)], self.order[a + hi : min(z, a + hi + max(k - lo, 0))]]
            at.append(np.full(len(rows[-2]) + len(rows[-1]), i))
        return np.concatenate(rows), np.concatenate(at)


def answer_queries(index: Index, books: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int, step: int = 128):
    rows, cols, scores = [], [], []
    n = len(index.x)
    for i in range(0, len(q), step):
        mine = q[i : i + step]
        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", mine, mine)), 1e-300)
        tables = np.einsum("mkd,nd->mkn", books, (mine / length[:, None]).astype(np.float32), optimize=True)
        rough = np.zeros((n, len(mine)), np.float32)
        for j in range(len(books)):
            rough += tables[j][index.codes[:, j]]
        rough *= index.scale[:, None]
        for b in range(len(mine)):
            # two more than asked for, so that the query's own row can't take a place
            some = np.argpartition(-rough[:, b], rerank)[: rerank + 1] if n > rerank + 1 else np.arange(n)
            exact = (index.x[some] * mine[b]).sum(axis=1)
            copies, at = index.rows_of(some, q_ids[i + b], k)
            exact = exact[at]
            keep = best_of(exact, index.ids[copies], k)
            rows.append(np.full(len(keep), i + b))
            cols.append(copies[keep])
            scores.append(exact[keep])
    join = lambda v, t: np.concatenate(v).astype(t) if v else np.empty(0, t)
    return join(rows, np.int64), join(cols, np.int64), join(scores, np.float64)


def nearest(vectors: DataFrame, is_query, k: int = K, rerank: int = RERANK, sample: int = SAMPLE, slot: int = SLOT) -> DataFrame:
    rows = clean(vectors).where(F.exists("v", lambda x: x != 0))
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "row").limit(sample).select("v").toArrow().column(0).combine_chunks()
    dim = max((len(x) for x in picked), default=0)
    m = matrix(picked, dim)
    unit = (m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]).astype(np.float32)
    books = train(unit) if len(unit) else np.zeros((0, 0, 0), np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # codebooks * codewords vectors

    def answer(full):
        b = shared.value
        if b.shape[2] < full:  # longer vectors than any of the sample
            b = np.pad(b, ((0, 0), (0, 0), (0, full - b.shape[2])))
        return lambda ids, x: Index(ids, x, b), lambda index, q_ids, q: answer_queries(index, b, q_ids, q, k, rerank)

    return search(rows, is_query, k, "double", answer, slot)


def op4_ann_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
