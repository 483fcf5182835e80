"""Exact and approximate search against brute force."""

import numpy as np
import pytest
from fixtures import DATA, written
from pyspark.sql import functions as F

from mosaicrank.llm import ann as A
from mosaicrank.llm import exact_topk as E

NAN, INF = float("nan"), float("inf")


def vectors(spark, path, n=300, dim=12, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).tolist()) for i in range(n)]
    rows[10] = (10, None)
    rows[11] = (11, [*rows[11][1][:-1], None])
    rows[20] = (20, [NAN] * dim)
    rows[21] = (21, [INF, *rows[21][1][1:]])
    rows[40] = (40, [0.0] * dim)
    rows[41] = (41, [])
    rows[43] = (43, rows[42][1])
    rows[44] = (44, rows[42][1])
    rows += [(None, rows[50][1]), (60, rows[60][1]), (60, rows[60][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", F.lit(1).alias("row"), F.lit(2).alias("slot"), F.lit(3).alias("score"))
    return rows, written(df, path)


def usable(v, zero):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(x != 0 for x in v))


def brute(rows, every, k, f, zero):
    good = [(i, f(v)) for i, v in rows if usable(v, zero)]
    out, done = [], set()
    for q, v in good:
        if q is None or q % every or q in done:
            continue
        done.add(q)
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, w in good if i != q]
        out += [(q, n + 1, None if c else i, -s) for n, (s, c, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("slot", [8192, 50])
def test_exact_topk(spark, tmp_path, slot):
    rows, df = vectors(spark, tmp_path / "v")
    got = [tuple(r) for r in E.exact_topk(df, F.col("vec_id") % 20 == 0, slot=slot).collect()]
    want = brute(rows, 20, 10, lambda v: [int(np.floor(1024 * x)) for x in v], True)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_topk_of_huge_numbers(spark, tmp_path):
    rows = [(i, [float(i) * 1e8, 3e9 - i]) for i in range(30)]
    df = written(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), tmp_path / "v")
    got = [tuple(r) for r in E.exact_topk(df, F.col("vec_id") % 10 == 0).collect()]
    cap = lambda x: max(-(2**63), min(2**63 - 1, x))
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 30, 10):
        scored = sorted((-cap(sum(a * b for a, b in zip(good[q], w, strict=True))), i) for i, w in good.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])]
    assert sorted(got) == sorted(want)


def test_bounds_prune():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(size=(4000, 64)) * 300 * np.exp(r.normal(size=(4000, 1))))
    index = E.Index(np.arange(4000), x)
    E.answer_queries(index, np.array([-1]), x[:1], 10)
    assert index.scored < 4000


def test_exact_topk_sql_query(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = sorted(map(tuple, E.op5_exact_topk(spark, DATA).collect()))
    assert got == sorted(c.execute(f"SELECT query_id, rank, vec_id, score FROM ({E.OP5_SQL})").fetchall())


@pytest.mark.parametrize("slot", [8192, 60])
def test_ann_finds_all_of_a_small_table(spark, tmp_path, slot):
    rows, df = vectors(spark, tmp_path / "v")
    got = [tuple(r) for r in A.nearest(df, F.col("vec_id") % 20 == 0, rerank=400, slot=slot).collect()]
    want = brute(rows, 20, 20, list, False)
    assert sorted((q, n, i) for q, n, i, _ in got if i is not None) == sorted((q, n, i) for q, n, i, _ in want if i is not None)
    scores = {(q, n): s for q, n, _, s in want}
    assert all(abs(s - scores[q, n]) < 1e-9 for q, n, _, s in got)


def test_ann_recall(spark, tmp_path):
    # clustered vectors of other lengths; the lookups see few of them exactly
    r = np.random.default_rng(4)
    x = (r.normal(size=(30, 64))[r.integers(0, 30, 6000)] + r.normal(size=(6000, 64))) * np.exp(0.3 * r.normal(size=(6000, 1)))
    df = written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), tmp_path / "v")
    found = A.nearest(df, F.col("vec_id") % 100 == 0, sample=3000).collect()
    hits = 0
    for q in range(0, 6000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert hits / (60 * 20) >= 0.9


def test_ann_recall_of_the_query(spark):
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = A.op4_ann_additive(spark, DATA).collect()
    hits = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        total += len(want)
        hits += len({i for _, i in want} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits / total >= 0.9 and len(got) == total


def test_ann_of_many_copies_keeps_the_smallest_ids():
    # a third of the rows are one vector, some ids repeat; the query is one of the copies, or near them
    r = np.random.default_rng(0)
    x, ids = r.normal(size=(3000, 16)), r.permutation(3000) // 2
    at = r.permutation(3000)[:1000]
    x[at] = x[at[0]]
    x[at[:500], 3] = -0.0
    x[at[500:], 3] = 0.0
    books = A.train((x[:1500] / np.linalg.norm(x[:1500], axis=1)[:, None]).astype(np.float32), codebooks=4, codewords=32)
    index = A.Index(ids, x, books)
    for q_id, q in [(int(ids[at].min()), x[at[0]]), (-1, x[at[0]]), (int(ids[at[5]]), x[at[0]] + 0.01 * r.normal(size=16))]:
        _, rows, scores = A.answer_queries(index, books, np.array([q_id]), q[None], 20, 256)
        want = sorted(i for i in ids[at] if i != q_id)[:20]
        assert ids[rows].tolist() == want
        assert np.allclose(scores, x[rows] @ q)


def test_small_samples_train_the_codebooks_together():
    x = np.random.default_rng(3).normal(size=(1000, 32)).astype(np.float32)
    plain, joint = (A.train(x, codebooks=4, rounds=n) for n in (0, 1))
    error = lambda books: np.square(x - A.decode(A.encode(x, books), books)).sum()
    assert error(joint) < 0.95 * error(plain)
    assert np.isfinite(A.train(x[:1], codebooks=4)).all()


def test_empty(spark, tmp_path):
    df = written(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), tmp_path / "v")
    assert E.exact_topk(df, F.col("vec_id") % 20 == 0).count() == 0
    assert A.nearest(df, F.col("vec_id") % 20 == 0).count() == 0
