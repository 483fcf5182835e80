"""Byte-level BPE over a table of distinct words.

A word here is what lies between two safe cuts: before a lone space or around a lone line feed
that has no white space beside it. The tokenizer's own splitting never crosses such a cut and
looks at nothing beyond it, so the ids of a text are the ids of its words, joined.

Texts are cut into chunks of whole documents. Within a chunk each distinct word gets a rank by
frequency, and documents become arrays of ranks. The word lists of all chunks are dealt by a
hash of the word, so that each distinct word meets the tokenizer once; its ids go back to the
chunks that hold it, and by rank into their documents. Decoding joins the ids of a chunk's
distinct words with the table of pieces (as many rows as the vocabulary) and concatenates; ids
are dense, so this join is a gather within the task and shuffles nothing. decode_ids() is the
same join between DataFrames, for ids that come without their words.

Chunks bound what a task holds, and only packed word lists and ranks are shuffled, never texts.
The two passes that form chunks must see documents alike, so docs must be a table that is read,
not a plan whose rows move.

Edge cases: null counts as empty; an empty text has no tokens and decodes to the empty text.
A special token's string within a text becomes its id, as the library does by default. Rows that
repeat each get their result. Extra columns don't matter. A text longer than a chunk is a chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, read, slices, trim

CHUNK_BYTES = 32 << 20
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_RUNS = (b"  ", b"\n\n", b" \n", b"\n ", b"\0")
_OTHER_SPACE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def split_words(text: bytes) -> list[bytes]:
    """Words that joined are the text, cut only where cuts are safe."""
    plain = not any(x in text for x in _RUNS) and len(text.translate(None, _OTHER_SPACE)) == len(text)
    if plain and (text.isascii() or not any(x in text for x in _WIDE_SPACE)):
        words = text.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0")
        return list(filter(None, words))
    return [w.encode() for w in _CUT.split(text.decode("utf-8", "replace")) if w]


def _chunks(batches, chunk_bytes: int):
    """Yields (chunk, words by falling frequency, [(ids column, ranks, words per document)])."""
    from pyspark import TaskContext

    base, k = TaskContext.get().partitionId() << 24, 0

    def finished():
        every = list(words)
        seen = np.zeros(len(every), np.int64)
        for _, at, _ in parts:
            seen += np.bincount(at, minlength=len(every))
        order = np.argsort(-seen, kind="stable")
        rank = np.empty(len(every), np.uint32)
        rank[order] = np.arange(len(every), dtype=np.uint32)
        return base + k, [every[i] for i in order.tolist()], [(ids, rank[at], counts) for ids, at, counts in parts]

    def fresh():
        found: defaultdict = defaultdict()
        found.default_factory = found.__len__
        return found, [], 0

    words, parts, size = fresh()
    for b in slices(batches, 128):
        texts = byte_rows(b.column(1))
        counts, at = np.zeros(len(texts), np.int32), []
        for i, text in enumerate(texts):
            mine = split_words(text)
            counts[i] = len(mine)
            at.append(np.fromiter(map(words.__getitem__, mine), np.uint32, len(mine)))
        parts.append((b.column(0), np.concatenate(at), counts))
        size += sum(map(len, texts))
        if size >= chunk_bytes:
            yield finished()
            k += 1
            words, parts, size = fresh()
            trim()
    if parts:
        yield finished()
    words, parts, size = fresh()
    trim()


def _pack(values: np.ndarray) -> bytes:
    """Small integers byte plane by byte plane, compressed: high planes are nearly all zero."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


def _pack_words(words: list[bytes]) -> bytes:
    size, blob = _pack(np.fromiter(map(len, words), np.uint32, len(words))), b"".join(words)
    return len(size).to_bytes(8, "little") + size + len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unpack_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    sizes, n = _unpack(data[8:at]), int.from_bytes(data[at : at + 8], "little")
    blob = pa.decompress(data[at + 8 :], n, codec="zstd", asbytes=True) if n else b""
    stops = np.cumsum(sizes.astype(np.int64))
    return [blob[i:j] for i, j in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]


def byte_pieces(vocab: dict[str, int]) -> list[bytes]:
    """The id-to-piece table of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return out


def encode_documents(docs: DataFrame, spec: str, chunk_bytes: int = CHUNK_BYTES, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text), and with
    with_ids also ids (comma-joined) and decoded. spec is the tokenizer's JSON."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)  # one vocabulary
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.selectExpr("doc_id", "cast(text as string) as text")

    def word_lists(batches):
        for chunk, words, _ in _chunks(batches, chunk_bytes):
            of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(buckets + 1))
            for b in range(buckets):
                ranks = sorted(order[edges[b] : edges[b + 1]].tolist(), key=words.__getitem__)  # sorted words pack tightly
                if ranks:
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([chunk], pa.int64()), pa.array([_pack(np.array(ranks))], pa.binary()), pa.array([_pack_words([words[r] for r in ranks])], pa.binary())], ["bucket", "chunk", "ranks", "words"])

    def positions(batches):
        for chunk, _, parts in _chunks(batches, chunk_bytes):
            for ids, at, counts in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([counts.tobytes()], pa.binary()), pa.array([_pack(at)], pa.binary())],
                    ["chunk", "doc_ids", "counts", "at"],
                )

    def encode(batches):
        from tokenizers import Tokenizer

        tokenizer, known, now = Tokenizer.from_str(shared.value), {}, None
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for b in slices(batches, 1):
            if b.column(0)[0].as_py() != now:
                now, known = b.column(0)[0].as_py(), {}
            words = _unpack_words(b.column(3)[0].as_py())
            new = [w for w in words if w not in known]
            for i in range(0, len(new), 2000):
                part = new[i : i + 2000]
                found = tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                known.update((w, e.ids) for w, e in zip(part, found, strict=True))
            ids = [known[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([_pack(sizes)], pa.binary()), pa.array([_pack(flat)], pa.binary())], ["chunk", "ranks", "sizes", "ids"])
        trim()

    cache: dict = {}

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if "pieces" not in cache:
            found = json.loads(shared.value)
            cache["pieces"] = pa.array(byte_pieces(found["model"]["vocab"] | {t["content"]: t["id"] for t in found["added_tokens"]}), pa.large_binary())
        lists = [[_unpack(x) for x in right.column(c).to_pylist()] for c in ("ranks", "sizes", "ids")]
        total = sum(map(len, lists[0]))
        ids, decoded, n_ids = [""] * total, [b""] * total, np.zeros(total, np.int64)
        for ranks, sizes, flat in zip(*lists, strict=True):
            n_ids[ranks] = sizes
            text, at = [str(i) for i in flat.tolist()], 0
            joined = cache["pieces"].take(pa.array(flat))
            ends = np.frombuffer(joined.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])] if len(flat) else np.zeros(len(sizes) + 1, int)
            blob = joined.buffers()[2].to_pybytes() if len(flat) else b""
            for r, n, i, j in zip(ranks.tolist(), sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids[r], decoded[r] = ",".join(text[at : at + n]), blob[i:j]
                at += n
        del lists
        rows: list[list] = [[] for _ in range(6 if with_ids else 4)]
        for k in range(left.num_rows):
            doc_ids, counts, at = (left.column(c)[k].as_py() for c in ("doc_ids", "counts", "at"))
            where, start = _unpack(at), 0
            for doc_id, n in zip(doc_ids, np.frombuffer(counts, np.int32).tolist(), strict=True):
                mine = where[start : start + n]
                start += n
                listed = mine.tolist()
                joined = ",".join([ids[i] for i in listed])
                text = b"".join([decoded[i] for i in listed])
                for row, v in zip(rows, (doc_id, int(n_ids[mine].sum()), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), joined, text), strict=False):
                    row.append(v)
        out = pa.table([pa.array(rows[0], left.schema.field("doc_ids").type.value_type), pa.array(rows[1], pa.int64()), *(pa.array(r, pa.string()) for r in rows[2:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(rows)])
        del ids, decoded, rows
        trim()
        return out

    listed = source.mapInArrow(word_lists, "bucket int, chunk long, ranks binary, words binary")
    encoded = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, "chunk long, ranks binary, sizes binary, ids binary")
    placed = source.mapInArrow(positions, f"chunk long, doc_ids array<{kind}>, counts binary, at binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids
    return placed.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(assemble, schema)


def decode_ids(rows: DataFrame, pieces: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) for rows of ids (arrays), by a join with pieces (id, piece binary).
    Keys must be unique. An id without a piece raises; null or no ids decode to nothing."""
    each = rows.select(F.col(key), F.posexplode_outer(ids).alias("pos", "id"))
    found = each.join(pieces, "id", "left")
    piece = F.when(F.col("id").isNull(), F.lit(b"")).when(F.col("piece").isNull(), F.raise_error(F.lit("an id without a piece"))).otherwise(F.col("piece"))
    listed = found.select(key, F.struct("pos", piece.alias("piece")).alias("p")).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return listed.select(key, F.aggregate(F.col("p.piece"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("decoded"))


def tokenizer_spec(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_spec())
