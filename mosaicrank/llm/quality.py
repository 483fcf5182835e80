"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in one pass of an Arrow kernel. Trees grow level by level on
binned statistics with the logistic loss; a fitted ensemble is four flat arrays that numpy walks
for all rows and trees at once.

Training reads a bounded sample: the MAX_LABELLED labelled rows of the training folds with the
smallest hashes of their row. Scores cover every whole text.

Edge cases: null text counts as empty; empty texts have defined statistics and score like any
other. A label without doc_id, or null, teaches nothing; where a doc_id has several labels the
smallest counts. Without labels every score is 0.5. Rows that repeat score alike. Extra columns
don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, fold, free_name, read, slices, with_row_key

MAX_LABELLED = 20_000
THRESHOLD = 0.7
HELD_OUT = 2
_ALL = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_ALL >= a) & (_ALL <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_SPACE = np.isin(_ALL, [32, 9, 10, 11, 12, 13])
_PLAIN = np.isin(_ALL, list(b".,;:'\"()-?"))
_SYMBOL = (_ALL > 32) & (_ALL < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_PLAIN
STATISTICS = 26


def statistics(text: bytes) -> list[float]:
    """STATISTICS numbers about one text."""
    a = np.frombuffer(text, np.uint8)
    words, n = text.split(), len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = np.bincount(a, minlength=256) if n else np.zeros(256, int)
    share = lambda mask: float(count[mask].sum()) / max(n, 1)
    probability = count[count > 0] / max(n, 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    common, lined, k = Counter(words), Counter(lines), max(len(words), 1)
    letters = max(int(count[_UPPER | _LOWER].sum()), 1)
    ends = np.flatnonzero(_SPACE[a[1:]] & ~_SPACE[a[:-1]]) if n > 1 else np.empty(0, int)
    last = a[ends] if len(ends) else np.zeros(1, np.uint8)
    same = a[1:] == a[:-1] if n > 1 else np.zeros(1, bool)
    symbols = [sum(1 for c in (x[:1], x[-1:]) if c and _SYMBOL[c[0]]) for x in lines[:1] + lines[-1:]] or [0]
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(common) / k,
        (common.most_common(1)[0][1] if common else 0) / k,
        sum(x == y for x, y in zip(words, words[1:], strict=False)) / k,
        float(np.log1p(len(lines))),
        1 - len(lined) / max(len(lines), 1),
        len(words) / max(len(lines), 1),
        count[_UPPER].sum() / letters,
        share(_DIGIT),
        share(_SPACE),
        share(_PLAIN),
        share(_SYMBOL),
        count[ord("|")] / max(n, 1),
        count[ord("!")] / max(n, 1),
        float((same & _SYMBOL[a[1:]]).mean()) if n > 1 else 0.0,
        share(_ALL > 127),
        float(-(probability * np.log2(probability)).sum()),
        len(zlib.compress(text, 1)) / max(n, 1),
        float(_SYMBOL[last].mean()),
        float((lengths <= 3).mean()),
        sum(1 for x in words if x.isupper()) / k,
        float(sum(symbols)),
    ]


def _statistic_batches(batches):
    """The last column is the text; the others pass."""
    for b in slices(batches):
        rows = [np.array(statistics(x), np.float32).tobytes() for x in byte_rows(b.column(b.num_columns - 1))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.binary())], [*b.schema.names[:-1], "stats"])


class Trees:
    """Boosted trees as flat arrays of shape (trees, nodes): feature (-1 at a leaf), threshold,
    value. The children of node i are 2i + 1 (at most the threshold) and 2i + 2."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.value = (np.empty((0, 2 ** (depth + 1) - 1), t) for t in (np.int16, np.float32, np.float64))

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.full(len(x), self.base)
        tree = np.arange(len(self.feature))[None, :]
        node, row = np.zeros((len(x), len(self.feature)), np.int32), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, node]
            right = x[row, np.maximum(f, 0)] > self.threshold[tree, node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return self.base + self.value[tree, node].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Level-wise histogram boosting with the logistic loss."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    out = Trees(float(np.log(mean / (1 - mean))), depth)
    if len(np.unique(y)) < 2:
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    logit, grown = np.full(len(y), out.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, threshold, value = np.full(size, -1, np.int16), np.zeros(size, np.float32), np.zeros(size)
        node = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            first, width = 2**level - 1, 2**level
            live = node >= first
            local = node[live] - first
            total_g, total_h = (np.bincount(local, v[live], width) for v in (g, h))
            value[first : first + width] = -rate * total_g / (total_h + l2)
            if level == depth:
                break
            best, where = np.full(width, 1e-6), [(-1, 0)] * width
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                slot, m = local * (len(c) + 1) + binned[live, j], len(c) + 1
                left_g, left_h = (np.cumsum(np.bincount(slot, v[live], width * m).reshape(width, m), axis=1)[:, :-1] for v in (g, h))
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (total_g**2 / (total_h + l2))[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k], where[k] = top[k], (j, int(at[k]))
            for k, (j, b) in enumerate(where):
                if j >= 0:
                    feature[first + k], threshold[first + k] = j, cuts[j][b]
                    mine = node == first + k
                    node[mine] = 2 * (first + k) + 1 + (binned[mine, j] > b)
        grown.append((feature, threshold, value))
        logit += value[node]
    out.feature, out.threshold, out.value = (np.stack([t[i] for t in grown]) for i in range(3))
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fits on rows of docs (doc_id, text) and labels (doc_id, quality) outside the held-out fold."""
    usable = F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)
    known = labels.where(usable).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("label"))
    keyed = with_row_key(docs.select("doc_id", "text"), "row")
    picked = keyed.select("row", "doc_id").join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(13)), "row").limit(max_labelled).select("row", "label")
    # picked has at most max_labelled rows
    texts = keyed.join(F.broadcast(picked), "row").select("row", "label", F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_statistic_batches, "row long, label int, stats binary").orderBy("row").toArrow()
    x = np.array([np.frombuffer(v, np.float32) for v in found.column(2).to_pylist()], np.float32).reshape(-1, STATISTICS)
    return fit_trees(x, np.array(found.column(1).to_pylist(), float))


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """docs with a column of scores, last; all other columns stay. Where docs has a column of that
    name, underscores are added to the new one's."""
    name = free_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees and nodes

    def batches(it):
        for b in slices(it):
            x = np.array([statistics(t) for t in byte_rows(b.column(b.num_columns - 1))], np.float32).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.probabilities(x))], [*b.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.select("*", F.col("text").cast("string").alias(free_name(docs, "text_in"))).mapInArrow(batches, schema)


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
