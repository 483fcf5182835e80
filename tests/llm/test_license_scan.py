"""License scans against containment over every window."""

import random

import numpy as np
from fixtures import DATA, edge_docs, empty_docs

from mosaicrank.llm import license_scan as L

R = random.Random(6)
FILL = [f"word{i}" for i in range(500)]


def brute(text):
    """Names of templates that the whole text contains to the threshold: what windows may find."""
    tokens = [w for w in map(L.normal, (text or "").split()) if w]
    out = set()
    for name, t in L.TEMPLATES.items():
        mine = [w for w in map(L.normal, t.split()) if w]
        k = min(5, len(mine))
        shingles = {tuple(mine[i : i + k]) for i in range(len(mine) - k + 1)}
        width = len(mine) - k + 1
        for at in range(max(len(tokens) - k + 1, 0)):
            held = {tuple(tokens[j : j + k]) for j in range(at, min(at + width, len(tokens) - k + 1))}
            if len(shingles & held) >= 0.8 * len(shingles) - 1e-9:
                out.add(name)
                break
    return out


def planted(n=60):
    texts = []
    for _ in range(n):
        words = [R.choice(FILL) for _ in range(R.randint(0, 400))]
        for name in R.sample(sorted(L.TEMPLATES), R.randint(0, 3)):
            t = L.TEMPLATES[name].split()
            if len(t) > 30 and R.random() < 0.5:
                t[len(t) // 2] = "changed"
            at = R.randint(0, len(words))
            words[at:at] = [("# " if R.random() < 0.3 else "") + w.upper() if R.random() < 0.3 else w for w in t]
        texts.append(" ".join(words))
    return texts


def test_finds_all_planted_templates():
    texts = planted()
    found = L.Scanner(L.TEMPLATES).scan([t.encode() for t in texts])
    for t, f in zip(texts, found, strict=True):
        assert {n for n, _, _ in f} >= brute(t)
        assert all(share >= 0.8 - 1e-9 for _, _, share in f)
    assert sum(len(f) for f in found) > 40


def test_bands_miss_rarely():
    for classes in L.Scanner(L.TEMPLATES).by_k.values():
        for c in classes:
            similar = 0.8 * max(c.block / 2.5, 1) / (2 * c.block + 0.2 * c.block / 1.25)
            assert (1 - min(similar, 0.99)) ** len(c.bands) <= L.MISS + 1e-12
    assert np.isfinite(L.MISS)


def test_whole_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in L.op3_license_scan(spark, DATA).collect():
        names = set(filter(None, r["licenses"].split(",")))
        assert names >= brute(texts[r["doc_id"]]) and len(names) == r["n_licenses"]


def test_edge_cases(spark, tmp_path):
    docs = edge_docs(spark, tmp_path / "d", clash=True)
    assert L.scan_licenses(docs).count() == 43
    assert L.scan_licenses(docs, {"none": " ! ", "a": "one long text", "b": "one long text"}).where("n_licenses = 2").count() == 1
    assert L.scan_licenses(empty_docs(spark, tmp_path / "e")).count() == 0


def test_common_grants_are_found_without_a_licence_line():
    texts = {
        "mit-grant": 'Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.',
        "lgpl-header": "# under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; version 2.1",
        "agpl-header": "// under the terms of the GNU Affero General Public License as\n// published by the Free Software Foundation, version 3",
        "cc0-1.0-waiver": "The author has waived all copyright and related or neighboring rights to this work.",
    }
    found = L.Scanner(L.TEMPLATES).scan([t.encode() for t in texts.values()])
    assert [[m[0] for m in f] for f in found] == [[n] for n in texts]


def test_every_place_is_reported():
    text = " ".join([L.TEMPLATES[n := sorted(L.TEMPLATES)[0]], *FILL[:400], L.TEMPLATES[n], *FILL[:400], L.TEMPLATES[n]])
    found = [m for m in L.Scanner({n: L.TEMPLATES[n]}).scan([text.encode()])[0]]
    words, size = text.split(), len(L.TEMPLATES[n].split())
    places = [i for i in range(len(words)) if words[i : i + size] == L.TEMPLATES[n].split()]
    assert len(places) == len(found) == 3
    assert all(share == 1 and at <= i < at + 10 * size for i, (_, at, share) in zip(places, found, strict=True))
