"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train linear numpy classifiers over the presence
of words and word beginnings. The loss is the class-prior-corrected risk
``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))`` with the logistic loss; where the bracket turns
negative a step goes against it instead, so that the risk can't fall below zero by overfitting.
The prior pi is the share of toxic rows among the labelled rows of the training folds; labels of
clean documents serve nothing else.

Training reads a bounded sample: MAX_POSITIVE confirmed documents and MAX_UNLABELLED documents
of the training folds, those with the smallest hashes of their row. Scores cover every whole text.

Edge cases: null text counts as empty and scores by the bias alone. A label without doc_id, or
null, teaches nothing; where a doc_id has several labels, one toxic label makes it toxic. Without
any confirmed toxic document all scores are 0. Rows that repeat score alike. Extra columns don't
matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, fold, free_name, read, slices, trim, with_row_key

MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
MAX_FEATURES = 4096
THRESHOLD = 0.3
HELD_OUT = 2
_BEGINNINGS = (4, 5, 6)
_CACHED = 200_000


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def token_features(token: str) -> tuple[int, ...]:
    """Hashes of a token without what stands around its letters, and of its beginnings; none of a
    token without letters. Words of any length count."""
    word = token.lower()
    i, j = 0, len(word)
    while i < j and not _letter(word[i]):
        i += 1
    while i < j and not _letter(word[j - 1]):
        j -= 1
    word = word[i:j]
    if not word:
        return ()
    parts = [f"w {word}", *(f"p{k} {word[:k]}" for k in _BEGINNINGS if len(word) > k)]
    return tuple(zlib.crc32(p.encode()) for p in parts)


def text_features(text: bytes) -> np.ndarray:
    found: set[int] = set()
    for token in set(text.decode("utf-8", "replace").split()):
        found.update(token_features(token))
    return np.array(sorted(found), np.uint32)


def _feature_batches(batches):
    for b in slices(batches):
        out = pa.array([text_features(x).tobytes() for x in byte_rows(b.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), out], ["positive", "features"])


class Model:
    """Weights of hashed features; several classifiers' logits are averaged into one."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.weights = dict(zip(ids.tolist(), weights.tolist(), strict=True))
        self.bias, self.prior = bias, prior

    def scores(self, texts: list[bytes], cache: dict) -> np.ndarray:
        out, known = np.empty(len(texts)), self.weights
        for i, text in enumerate(texts):
            hits: set[int] = set()
            for token in set(text.decode("utf-8", "replace").split()):
                found = cache.get(token)
                if found is None:
                    found = tuple(x for x in token_features(token) if x in known)
                    if len(cache) >= _CACHED:
                        cache.clear()
                    cache[token] = found
                if found:
                    hits.update(found)
            out[i] = self.bias + sum(known[x] for x in sorted(hits))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500))) if self.prior > 0 else np.zeros(len(texts))


def _select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """The features that stand out most among the positives, by a two-sample z."""
    ids, n = np.unique(np.concatenate(pos), return_counts=True)
    u_ids, u_n = np.unique(np.concatenate(unl), return_counts=True) if unl else (np.empty(0, np.uint32), np.empty(0, int))
    at = np.searchsorted(u_ids, ids).clip(0, max(len(u_ids) - 1, 0))
    m = np.where(u_ids[at] == ids, u_n[at], 0) if len(u_ids) else np.zeros(len(ids))
    p, u = n / len(pos), m / max(len(unl), 1)
    q = (n + m + 1) / (len(pos) + len(unl) + 2)
    z = (p - u) / np.sqrt(q * (1 - q).clip(1e-9) * (1 / len(pos) + 1 / max(len(unl), 1)))
    good = np.flatnonzero((n >= 3) & (z > 5))
    return np.sort(ids[good[np.argsort(-z[good], kind="stable")[:MAX_FEATURES]]])


def _rows(docs: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows over ids: column numbers, and where each row starts."""
    cols, ptr = [], [0]
    for d in docs:
        at = np.searchsorted(ids, d).clip(0, len(ids) - 1)
        cols.append(at[ids[at] == d])
        ptr.append(ptr[-1] + len(cols[-1]))
    return np.concatenate(cols), np.array(ptr)


def nnpu_fit(pos, unl, n_features: int, prior: float, seed: int, steps: int = 400, rate: float = 0.1, decay: float = 2e-5):
    """Adam on the non-negative risk; pos and unl are sparse rows. Returns weights and bias."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, n_features), -2.0
    moment, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    weight = [rng.exponential(1.0, len(p) - 1) for _, p in (pos, unl)]  # a Bayesian bootstrap for each classifier
    weight = [x / x.sum() for x in weight]
    each = [np.diff(p) for _, p in (pos, unl)]

    def logits(rows):
        cols, ptr = rows
        total = np.concatenate([[0.0], np.cumsum(w[cols])])
        return total[ptr[1:]] - total[ptr[:-1]] + b

    def gradient(rows, size, g):
        return np.append(np.bincount(rows[0], np.repeat(g, size), n_features), g.sum())

    for step in range(1, steps + 1):
        fp, fu = logits(pos), logits(unl)
        sp, su = (1 / (1 + np.exp(-np.clip(x, -60, 60))) for x in (fp, fu))
        soft = lambda x: np.logaddexp(0, x)
        negative = weight[1] @ soft(fu) - prior * (weight[0] @ soft(fp))
        g_neg = gradient(unl, each[1], weight[1] * su) - prior * gradient(pos, each[0], weight[0] * sp)
        g = -g_neg if negative < 0 else prior * gradient(pos, each[0], weight[0] * (sp - 1)) + g_neg
        g[:-1] += decay * w
        moment, second = 0.9 * moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (1 - step / steps * 0.9) * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of logits under which unlabelled text averages the prior; of those, the
    scale that makes the confirmed examples likeliest. A prior that's a little off then spreads
    thinly over the texts without evidence and can't lift them to the threshold."""
    mean = lambda x: float((1 / (1 + np.exp(-np.clip(x, -500, 500)))).mean())
    best = None
    for scale in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        low, high = -200.0, 200.0
        for _ in range(60):
            shift = (low + high) / 2
            low, high = (low, shift) if mean(scale * unl + shift) > prior else (shift, high)
        likely = -float(np.logaddexp(0, -(scale * pos + shift)).mean())
        if best is None or likely > best[0]:
            best = (likely, scale, shift)
    return best[1], best[2]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, models: int = 3) -> Model:
    """Fits on rows of docs (doc_id, text) outside the held-out fold and labels (doc_id, toxic)."""
    held = lambda c: fold(c) == HELD_OUT
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    none = Model(np.empty(0, np.uint32), np.empty(0), 0.0, 0.0)
    if not prior:
        return none
    keyed = with_row_key(docs.select("doc_id", "text"), "row")
    rows = keyed.where(~held(F.col("doc_id"))).select("row", "doc_id")
    order = (F.xxhash64("doc_id", F.lit(7)), "row")
    pos = rows.join(known.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(max_positive)
    unl = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "row").limit(max_unlabelled)
    picked = pos.select("row", F.lit(1).alias("positive")).unionByName(unl.select("row", F.lit(0).alias("positive")))
    # picked has at most max_positive + max_unlabelled rows
    texts = keyed.join(F.broadcast(picked), "row").select("positive", F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_feature_batches, "positive int, features binary").toArrow()
    flags = found.column(0).to_pylist()
    feats = [np.frombuffer(x, np.uint32) for x in found.column(1).to_pylist()]
    order_of = sorted(range(len(flags)), key=lambda i: (flags[i], feats[i].tobytes()))  # the order of rows must not matter
    p, u = ([feats[i] for i in order_of if flags[i] == k] for k in (1, 0))
    if not p:
        return none
    ids = _select(p, u)
    if not len(ids):
        return Model(ids, np.empty(0), float(np.log(prior / max(1 - prior, 1e-9))), prior)
    sparse = _rows(p, ids), _rows(u or [ids[:0]], ids)
    fits = [nnpu_fit(*sparse, len(ids), prior, seed) for seed in range(models)]
    w, b = np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))
    logits = lambda rows: np.add.reduceat(np.append(w[rows[0]], 0.0), rows[1][:-1]) * (np.diff(rows[1]) > 0) + b
    scale, shift = calibrate(*(logits(x) for x in sparse), prior)
    del found, feats, p, u, sparse
    trim()
    return Model(ids, scale * w, scale * b + shift, prior)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores, last; all other columns stay. Where docs has a column of that
    name, underscores are added to the new one's."""
    name = free_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES weights

    def batches(it):
        cache: dict = {}
        for b in slices(it):
            scores = pa.array(shared.value.scores(byte_rows(b.column(b.num_columns - 1)), cache))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*b.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select("*", F.col("text").cast("string").alias(free_name(docs, "text_in"))).mapInArrow(batches, schema)


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at or over the threshold. Documents without any evidence,
    which score as an empty text does, stay whatever the prior is."""
    name, model = free_name(docs, "toxicity"), train(docs, labels)
    base = float(model.scores([b""], {})[0])
    return score(docs, model, name).where((F.col(name) < threshold) | (F.col(name) <= base)).select(*docs.columns)
