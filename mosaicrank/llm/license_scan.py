"""License scans: MinHash bands over overlapping windows, verified by exact containment.

Words are lower-cased and stripped of what stands around letters and digits; words without any
are dropped, so comment signs don't matter. A template's shingles are of WORDS words, or of all
its words if it has fewer. Templates are classed by size: a class has blocks of at least 1.25
times its templates' shingles, and a window is two adjacent blocks, one block on from the last, so
whatever is no longer than a block lies whole within a window. Each band is one MinHash value; the
number of bands follows from the least Jaccard similarity that a window with a match can have, so
that all bands miss it with a probability of MISS at most. A window that shares a band with a
template is verified: the share of the template's shingles within it must reach THRESHOLD.

Templates are a parameter of at most MAX_TEMPLATES texts. Everything else is one pass over
slices of whole texts, with no shuffle.

Edge cases: null and empty texts have no matches. Equal templates each match. A template without
words never matches. Repeated rows each get their result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_rows, read, slices

WORDS = 5
THRESHOLD = 0.8
MISS = 1e-4
MAX_TEMPLATES = 10_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_CACHED = 300_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-disclaimer": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
    "bsd-no-endorsement": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "epl-2.0-header": "are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-waiver": "has waived all copyright and related or neighboring rights to this work",
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def normal(token: str) -> str:
    return _EDGES.sub("", token.lower())


class _Hashes(dict):
    """The hash of each token's normal form; 0 where nothing is left."""

    def __missing__(self, token):
        word = normal(token)
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") | 1 if word else 0
        self[token] = value
        return value


def _shingle(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; as many as words, the last k - 1 without meaning."""
    out = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x100000001B3) + np.concatenate([h[j:], np.zeros(min(j, len(h)), np.uint64)])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _permutations(n: int) -> list[tuple[np.uint64, np.uint64]]:
    rng = np.random.default_rng(17)
    return [(np.uint64(int(a) | 1), np.uint64(b)) for a, b in rng.integers(1, 2**63, (n, 2))]


class _Class:
    """Templates of one shingle length and block size, with their band values."""

    def __init__(self, k: int, block: int, miss: float, threshold: float):
        self.k, self.block, self.names, self.shingles = k, block, [], []
        # a window holds at least threshold of the template and at most 2 * block shingles
        least = threshold * max(block / 2.5, 1)
        similar = least / (2 * block + (1 - threshold) * block / 1.25)
        self.bands = _permutations(int(np.ceil(np.log(miss) / np.log(1 - min(similar, 0.99)))))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD, miss: float = MISS, words: int = WORDS):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.threshold, self.hashes, classes = threshold, _Hashes(), {}
        for name, text in sorted(templates.items()):
            tokens = [w for w in map(normal, text.split()) if w]
            if not tokens:
                continue
            k = min(words, len(tokens))
            shingles = {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)}
            block = 1 << int(np.ceil(np.log2(1.25 * (len(tokens) - k + 1))))
            c = classes.setdefault((k, block), _Class(k, block, miss, threshold))
            c.names.append(name)
            c.shingles.append(shingles)
        self.by_k = defaultdict(list)
        for (k, _), c in sorted(classes.items()):
            with np.errstate(over="ignore"):
                sets = [_shingle(np.array([self.hashes[w] for s in sorted(t) for w in s], np.uint64), k)[::k] for t in c.shingles]
                c.values = [np.array([(x * a + b).min() for x in sets], np.uint64) for a, b in c.bands]
            self.by_k[k].append(c)

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, float]]]:
        """For each text its matches (template, first word of the window, containment), one for each
        place: of matching windows that overlap the best stands for all."""
        if len(self.hashes) > _CACHED:
            self.hashes.clear()
        found: list[list] = [[] for _ in texts]
        tokens, sizes, hashed = [], [], []
        for text in texts:
            mine = text.decode("utf-8", "replace").split()
            h = np.fromiter(map(self.hashes.__getitem__, mine), np.uint64, len(mine))
            keep = np.flatnonzero(h)
            tokens.append((mine, keep))
            hashed.append(h[keep])
            sizes.append(len(keep))
        sizes = np.array(sizes, np.int64)
        h = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
        if not len(h):
            return found
        first = np.cumsum(sizes) - sizes
        for k, classes in self.by_k.items():
            s = _shingle(h, k)
            ends = np.repeat(first + sizes - k, sizes) < np.arange(len(h))  # runs that would cross into the next text
            layouts = []
            for c in classes:
                blocks = -(-sizes // c.block)
                doc = np.repeat(np.arange(len(texts)), blocks)
                start = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * c.block
                layouts.append((c, doc, start, np.append(doc[1:] == doc[:-1], False), np.zeros((len(doc), len(c.names)), bool)))
            for i in range(max(len(c.bands) for c in classes)):
                a, b = next(c.bands[i] for c in classes if i < len(c.bands))
                with np.errstate(over="ignore"):
                    v = s * a + b
                v[ends] = _NONE
                for c, _, start, more, hit in layouts:
                    if i < len(c.bands):
                        low = np.minimum.reduceat(v, start)
                        low[:-1] = np.where(more[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                        for t, value in enumerate(c.values[i]):
                            hit[:, t] |= low == value
            for c, doc, start, _, hit in layouts:
                runs: dict = defaultdict(list)  # verified windows of a text and a template; those that overlap are one
                for w, t in zip(*np.nonzero(hit), strict=True):
                    d = int(doc[w])
                    mine, keep = tokens[d]
                    at = int(start[w] - first[d])
                    near = [normal(mine[j]) for j in keep[at : at + 2 * c.block + k - 1]]
                    held = {tuple(near[j : j + k]) for j in range(min(2 * c.block, len(near) - k + 1))}
                    share = len(c.shingles[t] & held) / len(c.shingles[t])
                    if share < self.threshold - 1e-9:
                        continue
                    own = runs[d, t]
                    if own and w == own[-1][0] + 1:
                        own[-1] = (w, *max(own[-1][1:], (share, int(keep[at])), key=lambda x: x[0]))
                    else:
                        own.append((w, share, int(keep[at])))
                for (d, t), own in runs.items():
                    found[d].extend((c.names[t], at, share) for _, share, at in own)
        for f in found:
            f.sort()
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined), spans (name:first word of the
    window:containment of every place, likewise) for every row of docs. Places whose windows overlap
    count as one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    templates = TEMPLATES if templates is None else templates
    Scanner(templates, threshold)  # bad templates fail here

    def batches(it):
        scanner = Scanner(templates, threshold)
        for b in slices(it, 256):
            found = scanner.scan(byte_rows(b.column(1)))
            names = [sorted({n for n, _, _ in f}) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(n) for n in names], pa.int64()), pa.array([",".join(n) for n in names], pa.string()), pa.array([",".join(f"{n}:{at}:{share:.4f}" for n, at, share in f) for f in found], pa.string())],
                ["doc_id", "n_licenses", "licenses", "spans"],
            )

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(batches, f"doc_id {kind}, n_licenses long, licenses string, spans string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
