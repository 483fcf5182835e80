"""SimHash components against all pairs."""

import random
import re

import xxhash
from fixtures import DATA, edge_docs, empty_docs

from mosaicrank.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(prints):
    """prints: {fingerprint: smallest id}; the smallest id of each fingerprint's component."""
    left, out = set(prints), {}
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            x = queue.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            queue += near
        ids = [prints[x] for x in group if prints[x] is not None]
        out.update(dict.fromkeys(group, min(ids) if ids else None))
    return out


def want(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    least = {}
    for i, p in prints:
        least[p] = i if least.get(p) is None else least[p] if i is None else min(i, least[p])
    c = brute_components(least)
    return sorted(((i, f"{p:016x}", c[p]) for i, p in prints), key=repr)


def test_whole_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op9_simhash_neardup(spark, DATA).collect()), key=repr) == want(rows)


def test_edge_cases(spark, tmp_path):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    found = S.simhash_components(S.with_row_key(docs.drop("row"), "row")).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found), key=repr)
    assert got == want(rows)
    kept = S.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    prints = {i: brute_print(t) for i, t in enumerate(t for _, t in rows)}
    root = brute_components({p: p for p in prints.values()})  # two components may share a repeated doc_id
    of = {}
    for i, (doc_id, _) in enumerate(rows):
        of.setdefault(root[prints[i]], []).append(doc_id)
    firsts = [min((x for x in g if x is not None), default=None) for g in of.values()]
    assert sorted(ids, key=repr) == sorted(firsts, key=repr)
    assert S.keep_one_of_each(empty_docs(spark, tmp_path / "e")).count() == 0


def test_masks_cover_every_triple():
    masks = S.covering_masks()
    cover = [sum((not m >> i & 1) << k for k, m in enumerate(masks)) for i in range(64)]
    assert len(masks) == 15
    assert all(cover[i] & cover[j] & cover[k] for i in range(64) for j in range(i, 64) for k in range(j, 64))


def test_links_in_crowded_buckets(spark):
    # many fingerprints near each other, and a limit that forces the splits
    r = random.Random(5)
    base, prints = r.getrandbits(64), set()
    while len(prints) < 600:
        x = base
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        prints.add(x if r.random() < 0.8 else r.getrandbits(64))
    prints |= {base ^ 1 << i for i in range(64)}
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp bigint")
    want_ = brute_components({p: p for p in prints})
    for limit in (4096, 8):
        root = {r["hi"] & (1 << 64) - 1: r["root"] for r in S.stars(S.links(df, limit)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(root.get(p, S._signed(p)), set()).add(p)
        assert {frozenset(g) for g in groups.values()} == {frozenset(p for p in prints if want_[p] == c) for c in set(want_.values())}
