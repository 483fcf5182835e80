"""Quantizers of token vectors: identity, bit buckets, products. Small numpy models; their
encode and decode are the kernels of Arrow functions."""

from __future__ import annotations

import numpy as np

from ..sources.schema import FieldParameters, QuantizerType


class Identity:
    """Exact floats."""

    kind = QuantizerType.NONE

    def __init__(self, dim: int):
        self.dim = dim

    def train(self, x: np.ndarray) -> Identity:
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x, "<f4").view(np.uint8).reshape(len(x), 4 * self.dim)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view("<f4").reshape(len(codes), self.dim)

    @property
    def code_size(self) -> int:
        return 4 * self.dim

    def to_dict(self) -> dict:
        return {"kind": int(self.kind), "dim": self.dim}


class Binarizer:
    """nbits per component: the bucket among cutoffs, decoded to the bucket's weight.

    Cutoffs and weights are quantiles of the residuals' per-dimension means, or of all their
    values with quantile_source "values" (means vanish where centroids are means of their own)."""

    kind = QuantizerType.BINARIZER

    def __init__(self, dim: int, nbits: int = 1, quantile_source: str = "dim_means", cutoffs=None, weights=None):
        if nbits not in (1, 2, 4, 8):
            raise ValueError("nbits must be 1, 2, 4 or 8")
        if dim % 8 or dim % (8 * nbits):
            raise ValueError("dim must be a multiple of 8 and of 8 * nbits")
        self.dim, self.nbits, self.quantile_source = dim, nbits, quantile_source
        self.cutoffs = None if cutoffs is None else np.asarray(cutoffs, float)
        self.weights = None if weights is None else np.asarray(weights, float)
        self.average = 0.0

    def train(self, residuals: np.ndarray) -> Binarizer:
        means = residuals.mean(axis=0)
        values = np.sort(means if self.quantile_source == "dim_means" else residuals.ravel())
        n = 1 << self.nbits
        at = [min(int(i / n * len(values)), len(values) - 1) for i in range(n)]
        self.cutoffs, self.weights, self.average = values[at[1:]], values[at], float(means.mean())
        return self

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cutoffs, x, side="right").astype(np.uint8)

    def encode(self, x: np.ndarray) -> np.ndarray:
        b = self.buckets(x)
        bits = (b[:, :, None] >> np.arange(self.nbits, dtype=np.uint8)) & 1  # low bit first
        return np.packbits(bits.reshape(len(x), -1), axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(codes), axis=1).reshape(len(codes), self.dim, self.nbits)
        return self.weights[(bits << np.arange(self.nbits, dtype=np.uint8)).sum(axis=2)].astype(np.float32)

    @property
    def code_size(self) -> int:
        return self.dim // 8 * self.nbits

    def to_dict(self) -> dict:
        listed = lambda a: None if a is None else a.tolist()
        return {"kind": int(self.kind), "dim": self.dim, "nbits": self.nbits, "quantile_source": self.quantile_source, "cutoffs": listed(self.cutoffs), "weights": listed(self.weights)}


class ProductQuantizer:
    """M sub-vectors, each coded by its nearest sub-centroid, by distance or inner product."""

    kind = QuantizerType.PRODUCT_ENCODER

    def __init__(self, dim: int, m: int, nbits: int = 8, metric: str = "euclidean", books=None):
        if m <= 0 or dim % m:
            raise ValueError("dim must be a multiple of the number of sub-quantizers")
        if metric not in ("euclidean", "inner_product"):
            raise ValueError("metric must be euclidean or inner_product")
        self.dim, self.m, self.nbits, self.metric = dim, m, nbits, metric
        self.books = None if books is None else np.asarray(books, float)  # (m, 2**nbits, dim // m)

    def _nearest(self, j: int, x: np.ndarray) -> np.ndarray:
        c = self.books[j]
        score = x @ c.T
        return np.argmax(score if self.metric == "inner_product" else score - 0.5 * (c * c).sum(axis=1), axis=1)

    def train(self, x: np.ndarray, rounds: int = 10, seed: int = 1234) -> ProductQuantizer:
        rng, k, parts = np.random.default_rng(seed), 1 << self.nbits, np.split(x.astype(float), self.m, axis=1)
        self.books = np.stack([p[rng.choice(len(p), k, replace=len(p) < k)] for p in parts])
        for _ in range(rounds):
            for j, p in enumerate(parts):
                own = self._nearest(j, p)
                n, total = np.bincount(own, minlength=k), np.zeros_like(self.books[j])
                np.add.at(total, own, p)
                self.books[j][n > 0] = total[n > 0] / n[n > 0, None]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._nearest(j, p) for j, p in enumerate(np.split(np.asarray(x, float), self.m, axis=1))], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][codes[:, j]] for j in range(self.m)], axis=1).astype(np.float32)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Inner products (m, 2**nbits) of a query's parts with all sub-centroids."""
        return np.stack([self.books[j] @ p for j, p in enumerate(np.split(np.asarray(query, float), self.m))])

    def adc(self, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        t = self.tables(query)
        return t[np.arange(self.m), codes].sum(axis=1)

    @property
    def code_size(self) -> int:
        return self.m

    def to_dict(self) -> dict:
        return {"kind": int(self.kind), "dim": self.dim, "m": self.m, "nbits": self.nbits, "metric": self.metric, "books": None if self.books is None else self.books.tolist()}


def make(p: FieldParameters):
    if p.quantization == QuantizerType.NONE:
        return Identity(p.dimensions)
    if p.quantization == QuantizerType.BINARIZER:
        return Binarizer(p.dimensions, p.nbits, p.quantile_source)
    if p.quantization == QuantizerType.PRODUCT_ENCODER:
        return ProductQuantizer(p.dimensions, p.num_subquantizers, p.nbits)
    raise ValueError("no quantization type")


def from_dict(x: dict):
    x = dict(x)
    return {QuantizerType.NONE: Identity, QuantizerType.BINARIZER: Binarizer, QuantizerType.PRODUCT_ENCODER: ProductQuantizer}[QuantizerType(x.pop("kind"))](**x)
