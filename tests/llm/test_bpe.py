"""BPE against the tokenizers library."""

import hashlib

import pytest
from fixtures import DATA, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mosaicrank.llm import bpe as B

SPEC = B.tokenizer_spec()
TOKENIZER = Tokenizer.from_str(SPEC)
TOKENIZER.no_truncation()
TOKENIZER.no_padding()
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def direct(text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(TOKENIZER.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("chunk", [B.CHUNK_BYTES, 2000])
def test_equals_the_library(spark, tmp_path, chunk):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    want = sorted(((r["doc_id"], *direct(r["text"])) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, B.encode_documents(docs, SPEC, chunk).collect()), key=repr) == want


def test_whole_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in B.op6_bpe_encode_decode(spark, DATA).collect()}
    assert got == {i: direct(t) for i, t in texts.items()}


def test_decode_ids(spark, tmp_path):
    found = B.encode_documents(edge_docs(spark, tmp_path / "d").where("doc_id < 13 and doc_id not in (10, 11)"), SPEC, with_ids=True)
    rows = found.withColumn("ids", F.when(F.col("ids") != "", F.split("ids", ",").cast("array<int>"))).select("doc_id", "ids", "decoded")
    pieces = spark.createDataFrame(list(enumerate(B.byte_pieces(TOKENIZER.get_vocab()))), "id int, piece binary")
    back = {r["doc_id"]: bytes(r["decoded"]) for r in B.decode_ids(rows.drop("decoded"), pieces).collect()}
    assert back == {r["doc_id"]: r["decoded"].encode() for r in rows.collect()}
    bad = spark.createDataFrame([(1, [10**6])], "doc_id int, ids array<int>")
    with pytest.raises(Exception, match="without a piece"):
        B.decode_ids(bad, pieces).collect()


def test_empty(spark, tmp_path):
    assert B.encode_documents(empty_docs(spark, tmp_path / "e"), SPEC).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab1'.s \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u180e\u2009\u2028\u3000é日\0<|>", "<|endoftext|>", "  ", " \n", "'ll", "don't"]), max_size=24).map("".join))
def test_cuts_are_safe(text):
    whole = TOKENIZER.encode(text, add_special_tokens=False).ids
    words = [w.decode() for w in B.split_words(text.encode())]
    assert "".join(words) == text
    assert [i for w in words for i in TOKENIZER.encode(w, add_special_tokens=False).ids] == whole
