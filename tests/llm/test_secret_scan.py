"""Secret scans against plain regex scans."""

import hashlib
import re

from fixtures import DATA, edge_docs, empty_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaicrank.llm import secret_scan as S

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    names = ["assign", "access", "hex"]
    said = ",".join(f"{names[k]}:{i}:{j}" for i, k, j in found)
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(said.encode()).hexdigest(), said)


def extra(text):
    return [(m.start(), 3 + k, m.end()) for k, r in enumerate(S.RULES[3:]) for m in re.finditer(r.pattern, text or "", re.ASCII)]


def test_whole_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in S.op7_secret_scan(spark, DATA).collect():
        want = brute(texts[r["doc_id"]])
        assert tuple(r)[1:5] == want[:4]
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in want[4].split(",") if x]


def test_edge_cases(spark, tmp_path):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    want = sorted(((r["doc_id"], *brute(r["text"])[:4]) for r in docs.collect()), key=repr)
    assert sorted((tuple(r)[:5] for r in S.scan_secrets(docs).collect()), key=repr) == want
    assert S.scan_secrets(empty_docs(spark, tmp_path / "e")).count() == 0


SCANNER = S.Scanner()
PARTS = ["password", "PassWd", "Secret", "toKen", "api_key", "APIKEY", "api-key", '"', "'", " ", ": ", "=", ":", "abcDEF12", "short", "AKIA", "ABCDEFGHIJ0123456", "0123456789abcdef0123456", "7", "é", "\U0001f600", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJabcdefgh.eyJabcdefgh.abcdefgh", "ſecret=abcdefgh"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=6))
def test_index_misses_nothing(texts):
    got = SCANNER.scan([t.encode() for t in texts])
    names = [r.kind for r in S.RULES]
    for text, spans in zip(texts, got, strict=True):
        base = ",".join(f"{names[k]}:{i}:{j}" for i, k, j in spans if k < 3)
        assert base == brute(text)[4]
        assert [x for x in spans if x[1] >= 3] == sorted(extra(text))


def test_trigram_queries():
    assert S.trigram_query("[0-9a-f]+") is None
    assert S.trigram_query("ab") is None
    assert S.trigram_query("abcd") == ("and", (("tri", 0x616263), ("tri", 0x626364)))
    assert S.trigram_query("(abc|xyz)+q?") == ("or", (("tri", 0x616263), ("tri", 0x78797A)))
    assert S.trigram_query("(abc|[x-z]+)") is None
    assert S.trigram_query("(abc)*") is None
