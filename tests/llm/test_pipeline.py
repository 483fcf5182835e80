"""The pipeline's stages, each held against what it was given."""

import corpus_pipeline as C
import pytest
from fixtures import edge_docs, empty_docs
from test_bpe import direct
from test_line_dedup import brute
from test_simhash import want

from mosaicrank.llm.common import materialize

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    for name, stage in C.STAGES:
        before = docs.collect()
        after = stage(spark, docs, DATA)
        if name != "bpe":
            assert after.columns == docs.columns
            docs = materialize(after, f"test-{name}")
        rows = docs.collect() if name != "bpe" else after.collect()
        texts = [(r["doc_id"], r["text"]) for r in before]
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            gone = {i for i, _ in texts} - {r["doc_id"] for r in rows}
            clean = [i for i, t in labels.items() if t == 0]
            assert sum(i in gone for i in clean) <= 0.05 * len(clean)
        elif name == "line_dedup":
            wanted = {i: x[0] for (i, _), x in zip(texts, brute(texts), strict=True)}
            assert {r["doc_id"]: r["text"] for r in rows} == wanted
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "simhash":
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c in want(texts)})
        elif name == "mixing":
            assert {(r["doc_id"], r["text"]) for r in rows} <= set(texts)
        else:
            assert sorted(tuple(r)[:3] for r in rows) == sorted((i, *direct(t)[:2]) for i, t in texts)


@pytest.mark.parametrize("make", [edge_docs, empty_docs])
def test_edge_cases(spark, tmp_path, make):
    make(spark, tmp_path / "documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    n = C.run(spark, str(tmp_path)).count()
    assert (n == 0) == (make is empty_docs)
