"""Secret scans over a trigram inverted index.

Each rule's regex gives a Boolean query over the trigrams that any match must hold: AND along a
literal, OR over alternatives, nothing for a class or a repeat that may vary. Documents are
indexed in segments, as a search engine's shards are: for each trigram that some rule asks for, a
segment has the sorted list of its documents that hold it. Lists are intersected and united, and
only the candidates meet the regex. A rule without mandatory trigrams scans every text fully.
A segment is a slice of one Arrow batch, so memory is bounded and nothing is shuffled.

Spans are code points, end exclusive. The base kinds come from the base rules alone; the others
add spans of further kinds and never replace one.

Edge cases: null and empty texts have no spans. Rows that repeat each get their own result. Extra
columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as sre  # the parser's own names
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_rows, read, slices

SEGMENT_ROWS = 512
SEGMENT_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. accept gets each leftmost non-overlapping match and may refuse it."""

    kind: str
    pattern: str
    accept: Callable = field(default=lambda m: True)
    any_case: bool = False
    base: bool = False
    run: tuple[bytes, int] | None = None  # the pattern is a run of these bytes, this long at least


RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: m.end(2) - m.start(2) >= 6, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20, base=True),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 24, base=True, run=(b"0123456789abcdef", 24)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(pattern: str, any_case: bool = False):
    """A Boolean tree: ("tri", code), ("and", parts), ("or", parts), or None where a match need
    hold no trigram. Codes are of lower-cased bytes, which over-selects and never misses."""

    def joined(kind, parts):
        return parts[0] if len(parts) == 1 else (kind, tuple(parts))

    def of_literal(text: bytes):
        text = text.lower()
        return [("tri", text[i] << 16 | text[i + 1] << 8 | text[i + 2]) for i in range(len(text) - 2)]

    def expand(tokens) -> list[bytes] | None:
        """All strings a short exact piece may be, or None."""
        found = [b""]
        for op, arg in tokens:
            if op is sre.LITERAL:
                options = [chr(arg).encode()]
            elif op is sre.IN and len(arg) <= 8 and all(x is sre.LITERAL for x, _ in arg):
                options = [chr(x).encode() for _, x in arg]
            elif op is sre.SUBPATTERN:
                options = expand(arg[3])
            elif op is sre.BRANCH:
                each = [expand(x) for x in arg[1]]
                options = None if any(x is None for x in each) else [y for x in each for y in x]
            elif op is sre.MAX_REPEAT and arg[1] <= 1:
                inner = expand(arg[2])
                options = None if inner is None else inner + [b""] * (arg[0] == 0)
            else:
                return None
            if options is None or len(found) * len(options) > 64:
                return None
            found = [x + y for x in found for y in options]
        return found

    def walk(tokens):
        parts, run = [], []

        def close():
            if run:
                options = [of_literal(x) for x in expand(run)]
                if all(options):
                    parts.append(joined("or", [joined("and", x) for x in options]))
                run.clear()

        for token in tokens:
            if expand([*run, token]) is not None:
                run.append(token)
                continue
            close()
            op, arg = token
            if op is sre.SUBPATTERN:
                inner = walk(arg[3])
            elif op is sre.BRANCH:
                each = [walk(x) for x in arg[1]]
                inner = None if None in each else joined("or", each)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                inner = walk(arg[2])
            else:
                inner = None
            if inner is not None:
                parts.append(inner)
        close()
        return joined("and", parts) if parts else None

    return walk(list(_parser.parse(pattern, re.ASCII)))


def _codes(query) -> set[int]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else {c for x in query[1] for c in _codes(x)}


class Segment:
    """Postings of a few documents for the trigrams that the rules ask for."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray, codes: np.ndarray):
        self.n = len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, self.n)
        stops = np.cumsum(sizes)
        a = np.frombuffer(b"".join(texts).lower(), np.uint8).astype(np.uint32)
        self.postings: dict[int, np.ndarray] = {}
        if len(a) < 3:
            return
        tri = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        at = np.flatnonzero(wanted[tri])
        doc = np.searchsorted(stops, at, side="right")
        inside = at + 2 < stops[doc]
        pairs = np.unique(tri[at[inside]].astype(np.int64) * self.n + doc[inside])
        code, doc = pairs // self.n, pairs % self.n
        for c, i, j in zip(codes, np.searchsorted(code, codes), np.searchsorted(code, codes, side="right"), strict=True):
            self.postings[int(c)] = doc[i:j]

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(query[1], np.empty(0, np.int64))
        found = None
        for part in query[1]:
            docs = self.candidates(part)
            if found is None:
                found = docs
            elif query[0] == "and":
                found = np.intersect1d(found, docs, assume_unique=True)
            else:
                found = np.union1d(found, docs)
            if query[0] == "and" and not len(found):
                break
        return found


def _runs(texts: list[bytes], members: bytes, least: int) -> list[tuple[int, int, int]]:
    """(document, start, end) in bytes of all maximal runs of least or more members: a full scan
    of all texts of a segment at once."""
    member = np.isin(np.arange(256), list(members))
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(member[a].view(np.int8), prepend=0))
    starts, stops = edge[::2], edge[1::2]
    long = stops - starts >= least
    starts, stops = starts[long], stops[long]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    doc = np.searchsorted(ends, starts, side="right")
    first = np.concatenate([[0], ends[:-1]])[doc] if len(doc) else doc
    return list(zip(doc.tolist(), (starts - first).tolist(), (stops - first).tolist(), strict=True))


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0), trigram_query(r.pattern, r.any_case)) for r in rules]
        self.codes = np.array(sorted({c for _, _, q in self.rules for c in _codes(q)}), np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end), sorted, in code points."""
        segment = Segment(texts, self.wanted, self.codes)
        spans: list[list] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            if rule.run:
                for d, i, j in _runs(texts, *rule.run):
                    spans[d].append((i, k, j))
                continue
            for d in segment.candidates(query):
                spans[d] += [(m.start(), k, m.end()) for m in regex.finditer(texts[d]) if rule.accept(m)]
        for text, found in zip(texts, spans, strict=True):
            if found:
                cuts = sorted({x for i, _, j in found for x in (i, j)})
                points, at, total = {}, 0, 0
                for c in cuts:
                    total += len(text[at:c].decode("utf-8", "replace"))
                    points[c], at = total, c
                found[:] = sorted((points[i], k, points[j]) for i, k, j in found)
        return spans


def _segments(batches):
    for b in slices(batches, SEGMENT_ROWS):
        texts = byte_rows(b.column(b.num_columns - 1))
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SEGMENT_BYTES):
                size += len(texts[stop])
                stop += 1
            yield b.slice(at, stop - at), texts[at:stop]
            at = stop


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it):
        scanner = Scanner()
        name = [r.kind for r, _, _ in scanner.rules]
        base = [r.base for r, _, _ in scanner.rules]
        say = lambda found: ",".join(f"{name[k]}:{i}:{j}" for i, k, j in found)
        for b, texts in _segments(it):
            spans = scanner.scan(texts)
            mine = [[x for x in s if base[x[1]]] for s in spans]
            counts = [pa.array([sum(x[1] == k for x in m) for m in mine], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(say(m).encode()).hexdigest() for m in mine], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([say(s) for s in spans], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    texts = docs.selectExpr("doc_id", "cast(text as string) as text")
    return texts.mapInArrow(batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
