"""The engine: types, quantizers, index, JSON, streams."""

import json
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaicrank import api
from mosaicrank.functions import vec
from mosaicrank.index import Index
from mosaicrank.operators import postings as P
from mosaicrank.operators import scoring as S
from mosaicrank.operators.kmeans import CoarseQuantizer, train_kmeans
from mosaicrank.operators.quantizers import Binarizer, Identity, ProductQuantizer, from_dict
from mosaicrank.plans.planner import probed
from mosaicrank.plans.query import AndQueryNode, OrQueryNode, Query, TermQueryNode, VectorQueryNode
from mosaicrank.sources import schema as T
from mosaicrank.sources.frames import documents_frame, read_json_documents
from mosaicrank.streaming.ingest import ingest

DIM = 16
KINDS = {"none": {}, "binarizer": {"nbits": 2, "quantile_source": "values"}, "product": {"num_subquantizers": 4, "nbits": 4}}
TYPES = {"none": T.QuantizerType.NONE, "binarizer": T.QuantizerType.BINARIZER, "product": T.QuantizerType.PRODUCT_ENCODER}


def schema(kind="none", **more):
    p = T.FieldParameters(dimensions=DIM, quantization=TYPES[kind], num_centroids=4, num_iterations=3, **(KINDS[kind] | more))
    return T.Schema([
        T.ColbertField("colbert", T.DataType.TENSOR, p),
        T.Field("tag", T.DataType.TEXT, [T.FieldRole.INDEXED, T.FieldRole.STORED]),
        T.IndexedField("n", T.DataType.INTEGER),
        T.IndexedField("x", T.DataType.FLOAT),
        T.IndexedField("at", T.DataType.DATETIME),
    ])


def vectors(i, n=3):
    x = np.random.default_rng(i).normal(size=(n, DIM))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def documents(ids, tag="test"):
    return [T.Document(i, [T.tensor("colbert", vectors(i)), T.text("tag", tag), T.integer("n", i % 2), T.real("x", 0.5), T.date("at", datetime(2024, 1, 1, tzinfo=UTC))]) for i in ids]


def vector_query(i):
    return VectorQueryNode(T.tensor("colbert", vectors(i)))


ALL = T.SearchOptions(k_top_centroids=4, n_probe=4)


@pytest.mark.parametrize("kind", KINDS)
def test_end_to_end(spark, tmp_path, kind):
    index = Index.create(spark, str(tmp_path / "a"), schema(kind))
    index.train(documents(range(40)))
    index.add(1, documents(range(10)))
    index.add(1, [T.Document(i, [T.tensor("colbert", vectors(i)), T.text("tag", "other")]) for i in range(10, 20)])
    for at in (index, Index.open(spark, str(tmp_path / "a"), read_only=True)):
        ids = lambda q, k=50, at=at: [r["doc_id"] for r in at.search(1, Query(q), k, ALL).collect()]
        assert ids(vector_query(3))[0] == 3
        assert set(ids(AndQueryNode([vector_query(3), TermQueryNode(T.text("tag", "test"))]))) <= set(range(10))
        assert set(ids(AndQueryNode([vector_query(3), TermQueryNode(T.integer("n", 1)), TermQueryNode(T.text("tag", "test"))]))) <= {1, 3, 5, 7, 9}
        assert ids(AndQueryNode([vector_query(3), TermQueryNode(T.text("tag", "missing"))])) == []
        assert set(ids(OrQueryNode([TermQueryNode(T.text("tag", "missing")), TermQueryNode(T.text("tag", "other"))]))) == set(range(10, 20))
        assert at.search(2, Query(vector_query(3)), 5, ALL).count() == 0  # another tenant
    with pytest.raises(PermissionError):
        Index.open(spark, str(tmp_path / "a"), read_only=True).remove(1, [1])
    copy = Index.copy_trained(index, str(tmp_path / "b"))
    assert copy.search(1, Query(vector_query(3)), 5, ALL).count() == 0
    copy.add(1, documents([77]))
    index.merge(str(tmp_path / "b"))
    assert [r["doc_id"] for r in index.search(1, Query(vector_query(77)), 1, ALL).collect()] == [77]


def test_changes(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "a"), schema())
    with pytest.raises(RuntimeError):
        index.search(0, Query(vector_query(0)), 1)
    index.set_coarse_quantizer("colbert", vectors(100, 4))
    index.add(0, documents(range(6)))
    index.remove(0, [1, 5])
    live = lambda: sorted(r["doc_id"] for r in index.search(0, Query(TermQueryNode(T.text("tag", "test"))), 99).collect())
    assert live() == [0, 2, 3, 4]
    index.update(0, documents([2], "new"))
    assert live() == [0, 3, 4]
    index.add(0, documents([1]))
    assert live() == [0, 1, 3, 4]
    index.compact(0)
    assert live() == [0, 1, 3, 4] and len(index.store.manifest["segments"]) == 1 and not index.store.manifest["tombstones"]
    assert {r["doc_id"]: r["tag"] for r in index.get_metadata(0, [2, 9]).collect()} == {2: "new", 9: None}
    assert index.get_mapping(0, "colbert").count() == 5
    found = index.search(0, Query(TermQueryNode(T.text("tag", "test"))), 2).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(0, 0.0), (1, 0.0)]
    for node in (TermQueryNode(T.real("x", 0.5)), TermQueryNode(T.date("at", 1704067200000))):
        assert index.search(0, Query(node), 99).count() == 5
    assert index.search(0, Query(TermQueryNode(T.integer("tag", 1))), 9).count() == 0
    assert index.search(0, Query(AndQueryNode([])), 9).count() == 0
    assert index.search(0, Query(TermQueryNode(T.text("tag", "test"))), 0).count() == 0
    assert index.explain_doc(0, Query(vector_query(0)), 0, ALL).count() == 1
    for bad in (TermQueryNode(T.text("nope", "x")), TermQueryNode(T.tensor("colbert", [[1.0] * DIM]))):
        with pytest.raises(ValueError):
            index.search(0, Query(bad), 1)
    with pytest.raises(ValueError):
        index.search(0, Query(vector_query(0)), 1, T.SearchOptions(n_probe=0))
    other = Index.create(spark, str(tmp_path / "b"), schema())
    other.set_coarse_quantizer("colbert", vectors(101, 4))
    with pytest.raises(ValueError):
        index.merge(other)
    with pytest.raises(ValueError):
        Index.create(spark, str(tmp_path / "b"), schema())
    with pytest.raises(FileNotFoundError):
        Index.open(spark, str(tmp_path / "c"))


def test_residual_mode_beats_raw_at_one_bit(spark, tmp_path):
    scores = {}
    for mode in ("raw", "residual"):
        index = Index.create(spark, str(tmp_path / mode), schema("binarizer", residual_mode=mode))
        index.train(documents(range(30)))
        index.add(0, documents(range(30)))
        scores[mode] = index.search(0, Query(vector_query(4)), 1, ALL).first()
    assert scores["residual"]["doc_id"] == 4


def test_full_probe_is_brute_force(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "a"), schema())
    index.set_coarse_quantizer("colbert", np.vstack([np.eye(DIM), -np.eye(DIM)]))
    index.add(0, documents(range(25)))
    found = index.search(0, Query(vector_query(7)), 25, T.SearchOptions(k_top_centroids=99, n_probe=99)).collect()
    want = sorted(((-S.max_sim(vectors(7), vectors(i)), i) for i in range(25)))
    got = {r["doc_id"]: r["score"] for r in found}
    assert [r["doc_id"] for r in found] == [i for _, i in want if i in got]
    assert all(abs(got[i] + s) < 1e-5 for s, i in want if i in got)


def test_schema_json_and_rules():
    s = schema("binarizer")
    assert T.Schema.from_json(s.to_json()) == s
    with pytest.raises(ValueError):
        s.add_field(T.StoredField("tag", T.DataType.TEXT))
    with pytest.raises(ValueError):
        T.Schema([T.ColbertField("c", T.DataType.TENSOR)]).check_trainable()
    d = documents([4])[0]
    assert T.Document.from_json(d.to_json(), s).fields[0].value == d.fields[0].value
    assert T.millis(datetime(1970, 1, 1, 0, 0, 1, 1999, tzinfo=UTC)) == 1001
    assert T.Version.parse("0.5.1") > T.Version.parse("0.5.0")


def test_validation(spark, tmp_path):
    for bad in (T.text("nope", "x"), T.integer("tag", 3)):
        with pytest.raises(ValueError):
            documents_frame(spark, schema(), [T.Document(1, [bad])])
    index = Index.create(spark, str(tmp_path / "a"), T.Schema([T.ColbertField("c", T.DataType.TENSOR, T.FieldParameters(dimensions=8, quantization=T.QuantizerType.NONE))]))
    with pytest.raises(ValueError):
        index.train([T.Document(1, [T.tensor("c", [[0.0] * 8])])])


def test_json_documents_and_api(spark, tmp_path):
    (tmp_path / "d.json").write_text("\n".join(d.to_json() for d in documents(range(3))))
    rows = read_json_documents(spark, schema(), str(tmp_path / "d.json")).orderBy("doc_id").collect()
    assert [len(r["colbert"]) for r in rows] == [3, 3, 3] and rows[1]["n"] == 1
    index = Index.create(spark, str(tmp_path / "a"), schema())
    index.set_coarse_quantizer("colbert", vectors(100, 4))
    assert api.add_json(index, 0, {"docs": [json.loads(d.to_json()) for d in documents(range(5))]}) == {"ok": True}
    tree = {"type": "AND", "children": [{"type": "TENSOR", "name": "colbert", "value": vectors(2).ravel().tolist()}, {"type": "TERM", "value": {"name": "tag", "data_type": "TEXT", "value": "test"}}]}
    out = api.search_json(index, 0, {"query": tree, "k": 3, "options": {"n_probe": 4, "k_top_centroids": 4}})
    assert out["ok"] and json.loads(out["results"][0])["id"] == 2 and json.loads(out["results"][0])["metadata"] == {"tag": "test"}
    assert api.remove_json(index, 0, {"ids": [2]}) == {"ok": True}
    assert not api.search_json(index, 0, {"query": {"type": "NOT"}})["ok"]
    assert not api.add_json(index, 0, {"docs": [{"id": 1, "fields": [{"name": "nope", "data_type": "TEXT", "value": "x"}]}]})["ok"]


def test_stream(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "a"), T.Schema([T.Field("tag", T.DataType.TEXT, [T.FieldRole.INDEXED])]))
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, tag string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, tag string").parquet(str(tmp_path / "in"))
    ingest(stream, index, 0, str(tmp_path / "cp")).awaitTermination(60)
    assert [r["doc_id"] for r in index.search(0, Query(TermQueryNode(T.text("tag", "b"))), 5).collect()] == [2]


def test_set_operations(spark):
    frame = lambda ids, s=1.0: spark.createDataFrame([(i, s) for i in ids], "doc_id bigint, score double")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(P.unite([frame([3, 4, 5]), frame([1, 2, 6])])) == [1, 2, 3, 4, 5, 6]
    assert ids(P.unite([frame([1, 2, 3]), frame([2, 3, 4])])) == [1, 2, 3, 4]
    assert ids(P.intersect([frame([3, 4, 5]), frame([2, 3, 4])])) == [3, 4]
    assert ids(P.intersect([P.unite([frame([1, 2, 3, 4]), frame([5, 6, 7, 8])]), frame([1, 3, 5, 7])])) == [1, 3, 5, 7]
    for method, want in (("sum", 5.0), ("product", 6.0), ("max", 3.0)):
        assert P.intersect([frame([1], 2.0), frame([1], 3.0)], method).first()["score"] == want
        assert P.unite([frame([1], 2.0), frame([1], 3.0)], method).first()["score"] == want


def test_scores():
    table = np.array([[1.0, 2, 3, 4, 5]])
    assert S.centroid_interaction(np.array([2, 2, 2, 2]), table) == 3.0
    assert S.threshold_score(np.array([2, 2, 2, 4]), table[0], 4) == 5.0
    assert S.best_by_centroid(np.array([[1.0, -2], [0.5, -1]])).tolist() == [1.0, 0.0]
    assert probed(np.array([[0.9, 0.5, -1.0], [0.1, 0.6, 0.2]]), 2, 2) == [(0, 0.9), (1, 0.6)]
    assert probed(-np.ones((2, 3)), 2, 5) == []
    q, t = vectors(1, 5), vectors(2, 10)
    assert abs(S.max_sim(q, 3 * t) - np.maximum((q @ t.T).max(axis=1), 0).sum()) < 1e-5


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([1, 2, 4, 8]), st.integers(0, 2**32 - 1))
def test_binarizer_decodes_to_weights(nbits, seed):
    x = np.random.default_rng(seed).normal(size=(5, 64))
    b = Binarizer(64, nbits, "values").train(x)
    assert b.encode(x).shape == (5, b.code_size)
    assert np.allclose(b.decode(b.encode(x)), b.weights[b.buckets(x)])
    assert np.allclose(from_dict(b.to_dict()).decode(b.encode(x)), b.decode(b.encode(x)))


def test_quantizers():
    for bad in ((12, 1), (8, 2), (16, 3)):
        with pytest.raises(ValueError):
            Binarizer(*bad)
    x = vectors(5, 6)
    assert np.array_equal(Identity(DIM).decode(Identity(DIM).encode(x)), x)
    for metric in ("euclidean", "inner_product"):
        pq = ProductQuantizer(DIM, 4, 2, metric).train(vectors(6, 40))
        codes = pq.encode(x)
        assert codes.shape == (6, 4) and codes.max() < 4
        assert np.allclose(pq.adc(x[0], codes), pq.decode(codes) @ x[0], atol=1e-5)
    with pytest.raises(ValueError):
        ProductQuantizer(DIM, 5)
    c = CoarseQuantizer(vectors(7, 3))
    ids, scores = c.search(x, 9)
    assert ids.shape == (6, 3) and (np.diff(scores, axis=1) <= 0).all() and (ids[:, 0] == c.assign(x)).all()
    assert np.allclose(c.residuals(x), x - c.reconstruct(c.assign(x)))
    c.add(vectors(8, 2))
    assert c.num_centroids == 5
    c.reset()
    with pytest.raises(RuntimeError):
        c.assign(x)


def test_kmeans_has_no_empty_cluster_and_repeats(spark):
    rows = [(vectors(i, 1)[0].tolist(),) for i in range(60)]
    tokens = spark.createDataFrame(rows, "v array<float>")
    a, b = (train_kmeans(tokens, 5, 4).centroids for _ in range(2))
    assert np.allclose(a, b, atol=1e-5)
    assert len(np.unique(CoarseQuantizer(a).assign(np.array([r[0] for r in rows], np.float32)))) >= 4


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>").select(vec.l2_norm("a").alias("n"), vec.normalize("b").alias("z"), vec.euclidean("a", "b").alias("e"), vec.bucket(F.lit(2.0), [1.0, 2.0, 3.0]).alias("k")).first()
    assert (row["n"], row["z"], row["e"], row["k"]) == (5.0, [0.0, 0.0], 5.0, 2)
