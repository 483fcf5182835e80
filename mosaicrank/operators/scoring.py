"""Scores of documents: centroid interaction first, late interaction on tokens after.

Both are Arrow kernels over a document's own row, with the query's matrix as a small broadcast;
neither shuffles. functions.vec.max_sim says the second as a Catalyst expression.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE_YET = -9999.0


def centroid_interaction(codes: np.ndarray, table: np.ndarray) -> float:
    """Sum over query tokens (rows of table) of the best score among a document's codes."""
    own = np.unique(codes)
    return float(np.maximum(table[:, own].max(axis=1), NONE_YET).sum()) if len(own) else NONE_YET * len(table)


def threshold_score(codes: np.ndarray, best: np.ndarray, threshold: float) -> float:
    """Sum over distinct codes of the centroid's best score, where that reaches threshold."""
    s = best[np.unique(codes)]
    return float(s[s >= threshold].sum())


def best_by_centroid(table: np.ndarray) -> np.ndarray:
    """For each centroid its best score over query tokens, at least 0."""
    return np.maximum(table.max(axis=0), 0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def max_sim(query: np.ndarray, tokens: np.ndarray) -> float:
    """Sum over query tokens of the best inner product with the normalised tokens, at least 0."""
    return float(np.maximum((query @ unit(tokens.astype(float)).T).max(axis=1), 0).sum()) if len(tokens) else 0.0


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a column of lists one after the other, the numbers of the rows that have
    any, and where those start."""
    size = np.array([0 if x is None else len(x) for x in column], np.int64)
    some = np.flatnonzero(size)
    values = np.concatenate([np.asarray(column.iloc[i]) for i in some]) if len(some) else np.empty(0)
    return values, some, (np.cumsum(size) - size)[some]


def plaid_column(table: np.ndarray, codes: str = "codes") -> Column:
    """centroid_interaction of each row, a batch at a time; 0 where codes are null."""
    table = np.asarray(table, float)

    @F.pandas_udf("double")
    def score(c: pd.Series) -> pd.Series:
        own, some, start = _flat(c)
        out = np.where(c.isna(), 0.0, NONE_YET * len(table))
        if len(some):
            out[some] = sum(np.maximum(np.maximum.reduceat(row[own.astype(int)], start), NONE_YET) for row in table)
        return pd.Series(out)

    return score(codes)


def maxsim_column(query: np.ndarray, quantizer, centroids: np.ndarray | None = None, residuals: str = "residuals", codes: str = "codes") -> Column:
    """Late interaction with decoded tokens, a batch at a time; with centroids they are added back
    first. A document without tokens scores 0."""
    query, size = np.asarray(query, float), quantizer.code_size

    @F.pandas_udf("double")
    def score(r: pd.Series, c: pd.Series) -> pd.Series:
        out = np.zeros(len(r))
        length = np.array([0 if x is None else len(x) // size for x in r], np.int64)
        some = np.flatnonzero(length)
        if not len(some):
            return pd.Series(out)
        tokens = quantizer.decode(np.frombuffer(b"".join(r.iloc[i] for i in some), np.uint8).reshape(-1, size))
        if centroids is not None:
            tokens = tokens + centroids[np.concatenate([np.asarray(c.iloc[i], int) for i in some])]
        near = query @ unit(np.asarray(tokens, float)).T
        out[some] = np.maximum(np.maximum.reduceat(near, (np.cumsum(length) - length)[some], axis=1), 0).sum(axis=0)
        return pd.Series(out)

    return score(residuals, codes)


def plaid_scores(codes: DataFrame, table: DataFrame) -> DataFrame:
    """The first pass relationally: codes (doc_id, cid), table (q, cid, s) -> (doc_id, score). Whether
    table is broadcast is left to Spark, which checks its size."""
    best = codes.distinct().join(table, "cid").groupBy("doc_id", "q").agg(F.max("s").alias("s"))
    return best.groupBy("doc_id").agg(F.sum("s").alias("score"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows; Spark keeps k a partition and never sorts the rest."""
    return df.orderBy(*(order or (F.desc("score"), "doc_id"))).limit(k)
