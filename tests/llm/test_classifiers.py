"""Quality and toxicity: held-out accuracy, folds, edge cases."""

import zlib

import numpy as np
import pytest
from fixtures import edge_docs, empty_docs

from mosaicrank.llm import quality as Q
from mosaicrank.llm import toxicity as X

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean((s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]))


@pytest.mark.parametrize("query, name, data, least", [(Q.op8_quality_gbdt, "quality", DATA, 0.95), (X.op10_toxicity_nnpu, "toxic", "/root/testdata/sf0.1", 0.95)])
def test_held_out_accuracy(spark, query, name, data, least):
    rows = query(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    labels = {r["doc_id"]: r[name] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    limit = {"quality": 0.7, "toxic": 0.3}[name]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held, strict=True)) >= least


@pytest.mark.parametrize("module, name", [(Q, "quality"), (X, "toxic")])
def test_edge_cases(spark, tmp_path, module, name):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None), (4, 1), (4, 1)], f"doc_id bigint, {name} int")
    found = module.score(docs, module.train(docs, labels))
    assert found.columns[:-1] == docs.columns and len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    assert len(rows) == 43 and all(0 <= r[found.columns[-1]] <= 1 for r in rows)
    one = {r[found.columns[-1]] for r in rows if r["doc_id"] == 20}
    assert len(one) == 1
    none = module.train(docs, labels.where("false"))
    assert {r[-1] for r in module.score(docs, none).collect()} == {0.5 if module is Q else 0.0}
    empty = empty_docs(spark, tmp_path / "e")
    assert module.score(empty, module.train(empty, labels)).count() == 0


def test_training_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from pyspark.sql import functions as F

    held = X.fold(F.col("doc_id")) == 2
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = X.train(docs, labels), X.train(docs, wrong)
    assert a.weights == b.weights and a.bias == b.bias
    c, d = Q.train(docs, labels), Q.train(docs, wrong)
    assert np.array_equal(c.value, d.value) and np.array_equal(c.threshold, d.threshold)


def test_drop_toxic(spark, tmp_path):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id bigint, toxic int")
    assert X.drop_toxic(docs, labels).columns == docs.columns
    assert X.drop_toxic(docs, labels).count() == 43


def test_trees_walk_as_they_grew():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = Q.fit_trees(x, y)
    assert ((model.probabilities(x) > 0.5) == y).mean() > 0.95

    def one(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while f[node] >= 0:
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node]
        return total

    assert np.allclose([one(row) for row in x[:40]], model.logits(x[:40]))


def test_nnpu_separates_with_few_positives():
    r = np.random.default_rng(1)
    rows = lambda n, p: [np.flatnonzero(r.random(20) < p).astype(np.uint32) for _ in range(n)]
    pos, neg = rows(60, np.r_[np.full(5, 0.8), np.full(15, 0.2)]), rows(500, np.full(20, 0.2))
    ids = np.arange(20, dtype=np.uint32)
    w, _ = X.nnpu_fit(X._rows(pos, ids), X._rows(neg + rows(60, np.r_[np.full(5, 0.8), np.full(15, 0.2)]), ids), 20, 0.1, 0)
    assert w[:5].mean() > w[5:].mean() + 2


def test_toxicity_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = X.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in X.score(docs.select("doc_id", "text"), model).collect():
        known = {f for w in (texts[r["doc_id"]] or "").split() for f in X.token_features(w)}
        logit = model.bias + sum(model.weights.get(f, 0.0) for f in known)
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-9


def test_words_of_any_length_count():
    word = "x" * 100
    assert X.token_features(word) and X.token_features("a") and not X.token_features("12.")
    assert X.token_features(f'("{word.upper()}!!"') == X.token_features(word) != X.token_features(word + "y")
    assert X.token_features("." * 200_000 + "a" + "." * 200_000) == X.token_features("a")
