"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes over word shingles. Two fingerprints link at RADIUS or
fewer differing bits; a component is what is reachable over links.

The search for links uses RADIUS + 1 = 4 dimensional structured masks: bit i has a nonzero
vector m(i) of GF(2)^4, and the mask of a nonzero v keeps the bits whose m(i) isn't orthogonal
to v. Up to three differing bits span at most three dimensions, so some v is orthogonal to all
of them: in that table the two fingerprints agree. With 15 masks no pair is missed.

Equal fingerprints collapse before the search. A bucket gives a spanning forest of its links,
never all its pairs. A bucket of more than ``bucket_limit`` fingerprints is split again: its
free bits fall into four groups, one of which must agree for a pair within the radius, until
buckets are small or so few bits are free that all members link. Components come from
alternating large-star and small-star steps, each written to the shared folder.

Edge cases: null and empty texts have no words and fingerprint 0, which links like any other.
Repeated rows share fingerprint and component. A null doc_id is never the smallest unless the
component has no other; then component_id is null. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, discard, free_name, materialize, read, slices, with_row_key

RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET_LIMIT = 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_CHUNK = 1 << 18


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, each keeping a little over half of them."""
    n = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 7 + i // n) % n for i in range(64)]
    return [sum(((m & v).bit_count() & 1) << i for i, m in enumerate(vectors)) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text as a signed 64-bit integer; 0 if there are no words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if n <= shingle:
        return _signed(digest(joined, SEED))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - shingle] + 1]).tolist()
    stops = ends[shingle - 1 :].tolist()
    total, counts = len(starts), np.zeros((8, 256), np.int64)
    for at in range(0, total, _CHUNK):
        part = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in part], dtype="<u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    flags = (counts @ _BITS) * 2 > total
    return int(np.packbits(flags, axis=1, bitorder="little").reshape(-1).view("<i8")[0])


def _fingerprint_batches(batches):
    for b in slices(batches):
        out = pa.array([fingerprint(x) for x in byte_rows(b.column(2))], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], ["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame, row: str = "row") -> DataFrame:
    """(row, doc_id, fp) of every row of docs; ``row`` names its column of row keys."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(row).alias("row"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, schema)


def _forest(fp: np.ndarray, radius: int, out: list) -> None:
    """Adds to out the edges of a spanning forest of the links among fp."""
    rest, queue = fp[1:], [fp[0]]
    while True:
        if not queue:
            if not len(rest):
                return
            queue, rest = [rest[0]], rest[1:]
        node = queue.pop()
        if len(rest):
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(len(found), node), found))
                queue.extend(found)


def _edge_batches(batches, radius):
    """Sorted (mask, key, fp) in, links out. A run of one mask and key may cross batches."""
    tail = None

    def links(mask, key, fp):
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        length, out = stops - starts, []
        two = starts[length == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        out.append((a[near], b[near]))
        for i in np.flatnonzero(length > 2):
            _forest(fp[starts[i] : stops[i]], radius, out)
        a, b = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["hi", "lo"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(i)) for i in range(3)]
        now[2] = now[2].view(np.uint64)
        if tail is not None:
            now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
        last = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        tail = [x[cut:] for x in now]
        if cut:
            yield links(*[x[:cut] for x in now])
    if tail is not None and len(tail[0]):
        yield links(*tail)


def _split_mask(mask: int) -> list[int]:
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j :: RADIUS + 1]) for j in range(RADIUS + 1)]


def links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (hi, lo) among the distinct fingerprints in column fp: enough of the pairs within
    the radius to connect what they connect."""
    spark = distinct.sparkSession
    keyed = lambda df, masks: df.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    rows = keyed(distinct, F.array(*[F.lit(_signed(m)) for m in covering_masks()]))
    parts: list[DataFrame] = []
    while True:
        heavy = materialize(rows.groupBy("mask", "key").count().where(F.col("count") > bucket_limit).select("mask", "key"), "simhash-heavy")
        light = rows.join(heavy, ["mask", "key"], "left_anti").repartition("mask", "key").sortWithinPartitions("mask", "key")
        parts.append(light.select("mask", "key", "fp").mapInArrow(lambda it: _edge_batches(it, RADIUS), "hi long, lo long"))
        masks = [r[0] for r in heavy.select("mask").distinct().collect()]  # at most 15 * 4^levels, not a row for each bucket
        if not masks:
            break
        rows = rows.join(heavy, ["mask", "key"], "left_semi")
        done = [m for m in masks if (~m & (1 << 64) - 1).bit_count() <= RADIUS]
        if done:  # all members of such a bucket link
            full = rows.where(F.col("mask").isin(done))
            least = full.groupBy("mask", "key").agg(F.min("fp").alias("lo"))
            parts.append(full.join(least, ["mask", "key"]).where("fp <> lo").select(F.col("fp").alias("hi"), "lo"))
        rest = [m for m in masks if m not in done]
        if not rest:
            break
        split = F.create_map(*[x for m in rest for x in (F.lit(m), F.array(*[F.lit(_signed(s)) for s in _split_mask(m & (1 << 64) - 1)]))])
        rows = rows.where(F.col("mask").isin(rest)).select("fp", split[F.col("mask")].alias("masks"))
        rows = materialize(keyed(rows, F.col("masks")).distinct(), "simhash-split")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(hi, lo) with hi > lo in, (hi, root) out: root is the smallest node of hi's component."""
    e = materialize(edges, "simhash-edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = sign(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialize(moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct(), "simhash-edges")
        after = sign(now)
        discard(e)
        e = now
        if after == before:
            break
        before = after
    return e.withColumnRenamed("lo", "root")


def simhash_components(docs: DataFrame, row: str = "row", bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(row, doc_id, fp, root, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, row), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    root = stars(links(distinct.select("fp"), bucket_limit))
    node = distinct.join(root, distinct.fp == root.hi, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    component = node.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(node.join(component, "root").select("fp", "root", "component_id"), "fp")


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for all documents."""
    docs = with_row_key(read(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_components(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (null last), the
    first in scan order among equals. All columns stay as they are."""
    row = free_name(docs, "row_key")
    keyed = with_row_key(docs, row)
    found = materialize(simhash_components(keyed, row, bucket_limit), "simhash-found")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    kept = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)
