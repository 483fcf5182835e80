"""A stated set of query vectors against all vectors, slot by slot.

Candidates are dealt into slots of about SLOT rows by a hash of their row key, so that repeats of
one vector spread; every query goes to every slot. A slot's rows arrive sorted, candidates first:
a kernel gathers the slot's candidates, then answers queries as they stream by and emits no more
than k rows for each query and slot. A window keeps the k best of each query.

Vectors that are null or hold null or non-finite components take no part. Vectors shorter than
the longest count as padded with zeros. Rows that share the query's vec_id are its own and aren't
candidates; a query that repeats is answered once. A row without vec_id is no query; as a
candidate it comes last among ties.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = 8192


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, vec_id long, v array<double>) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & finite)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows, padded with zeros to dim."""
    out = np.zeros((len(column), dim))
    size = np.diff(np.asarray(column.offsets))
    out[np.repeat(np.arange(len(column)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten())
    return out


def search(rows: DataFrame, is_query: Column, k: int, score_type: str, answer, slot: int = SLOT) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query by score, ties to smaller vec_id.

    rows is what clean() gives. answer(dim) makes a pair of functions: one indexes a slot,
    (ids, matrix) -> index, one answers queries, (index, ids, matrix) -> (query row numbers,
    candidate row numbers, scores), at most k for each query."""
    size, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    slots, dim = max(1, -(-size // slot)), dim or 0
    own = F.pmod(F.xxhash64("row"), F.lit(slots)).cast("int")
    first = rows.where(is_query).groupBy("vec_id").agg(F.min_by("v", "row").alias("v"))
    queries = first.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("query"), "vec_id", "v")
    dealt = rows.select(own.alias("slot"), F.lit(0).alias("query"), "vec_id", "v").unionByName(queries).repartition("slot").sortWithinPartitions("slot", "query")

    def kernel(batches):
        build, reply = answer(dim)
        now, gathered, index, ids = None, [], None, None
        for b in batches:
            at_slot, query = np.asarray(b.column(0)), np.asarray(b.column(1))
            cuts = np.flatnonzero(np.diff(at_slot) | np.diff(query)) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if i == j:
                    continue
                if at_slot[i] != now:
                    now, gathered, index, ids = at_slot[i], [], None, None
                part = b.slice(i, j - i)
                if not query[i]:
                    gathered.append((part.column(2), matrix(part.column(3), dim)))
                    continue
                if index is None:
                    if not gathered:
                        continue
                    ids = pa.concat_arrays([x for x, _ in gathered])
                    known = np.where(np.asarray(ids.is_null()), np.iinfo(np.int64).max, np.asarray(ids.fill_null(0)))
                    index, gathered = build(known, np.concatenate([m for _, m in gathered])), []
                for s in range(0, len(part), 512):
                    q = part.slice(s, 512)
                    q_ids = np.asarray(q.column(2))
                    a, c, score = reply(index, q_ids, matrix(q.column(3), dim))
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), ids.take(pa.array(c, pa.int64())), pa.array(score)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(kernel, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k largest scores, ties to smaller ids, best first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
