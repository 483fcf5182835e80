"""Mixing: targets, bounds, nearness, repeatability."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import DATA, SCHEMA, edge_docs, empty_docs, written

from mosaicrank.llm import mixing as M
from mosaicrank.llm.common import with_row_key

WORD = M.WORD


def water_fill(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Targets by repeated resharing; sizes by source in order."""
    total, capped, target = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i % 3] for i in free)
        for i in free:
            target[i] = left * weights[i % 3] / w
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        capped.update(over)
        for i in over:
            target[i] = most * sizes[i]


def check(rows):
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, water_fill([size[s] for s in names]), strict=True)) if names else {}
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_whole_table(spark):
    one = M.op2_mix_sources(spark, DATA).collect()
    check(one)
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in one} == {i: len(re.findall(WORD, t or "")) for i, t in texts.items()}
    assert sorted(map(tuple, one)) == sorted(map(tuple, M.op2_mix_sources(spark, DATA).collect()))


@pytest.mark.parametrize("bucket, fan", [(4096, 256), (4, 2)])
def test_edge_cases_and_tree(spark, tmp_path, monkeypatch, bucket, fan):
    monkeypatch.setattr(M, "BUCKET", bucket)
    monkeypatch.setattr(M, "FAN", fan)
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    from pyspark.sql import functions as F

    found = M.mix(with_row_key(docs.drop("row"), "row")).withColumn("taken", F.col("size") * F.col("copies"))
    rows = found.collect()
    assert len(rows) == 43
    check(rows)
    out = M.take_copies(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_hot_source_and_empty(spark, tmp_path):
    assert M.take_copies(empty_docs(spark, tmp_path / "e")).count() == 0
    rows = [(i % 50, "w " * (i % 7), None, "hot" if i % 3 else f"s{i}", None) for i in range(3000)]
    docs = with_row_key(written(spark.createDataFrame(rows, SCHEMA), tmp_path / "h"), "row")
    from pyspark.sql import functions as F

    check(M.mix(docs).withColumn("taken", F.col("size") * F.col("copies")).collect())


def test_pair_keeps_words_and_means():
    r = np.random.default_rng(3)
    for _ in range(300):
        p, q, s, t = r.random(), r.random(), r.integers(1, 50), r.integers(1, 50)
        outs = [M.pair(p, s, q, t, u) for u in (np.arange(4000) + 0.5) / 4000]
        assert all(abs(a * s + b * t - p * s - q * t) < 1e-9 and (a in (0, 1) or b in (0, 1)) for a, b in outs)
        assert abs(np.mean([a for a, _ in outs]) - p) < 2e-3
