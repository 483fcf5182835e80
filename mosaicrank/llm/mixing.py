"""Mixing sources to target weights by pivotal dependent rounding.

A source's size is its number of words. Targets share the sum of all sizes by weight, none over
``most`` times its source's size; what is over is shared again by weight. A document's wish is
target / source size copies: its whole part is certain, its fraction is a copy probability.

Fractions meet in pairs. The words that a fraction stands for (fraction * size) move from one
document of a pair to the other, until one of the two is at 0 or 1; the direction is random with
odds under which no probability changes in the mean. The words of a source thus stay the same in
every step. Documents of a source are dealt into buckets of about BUCKET rows; each bucket leaves
one fraction at most, and FAN buckets' leftovers meet in the next level of a reduction tree. The
last leftover of a source is drawn by itself, so what a source takes misses its target by less
than one document.

Order and random numbers come from hashes of doc_id and size, so reruns agree. Only ids that
repeat more than BUCKET times are spread by scan order.

Edge cases: null text has no words. A null source is a source, last in order. Documents without
words take part in no pair, and get the whole part of their wish. Sources without words have
target 0 and no copies. Repeated rows are documents of their own. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, read, with_row_key

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BUCKET = 4096
FAN = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, sid, source_size, source_rows, target) from rows of (source, size)."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # ranks by code point without one task for all: a range-partitioned sort, then offsets by partition
    ordered = materialize(total.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mixing-sources")
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}  # a row for each partition
    offset, at = [], 0
    for part in sorted(sizes):
        offset += [F.lit(part), F.lit(at)]
        at += sizes[part]
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    start = F.create_map(*offset)[F.col("part")] if offset else F.lit(0)
    ranked = ordered.withColumn("sid", (local + start).cast("long"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.withColumn("weight", cycle[(F.col("sid") % len(weights)).cast("int")]).drop("part"), "mixing-ranked")
    cap, level, before = F.col("source_size") * most, 0.0, None
    full = ranked.agg(F.sum("source_size")).first()[0] or 0
    while full:
        capped = cap < F.col("weight") * level
        held, loose, n = ranked.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("int"))).first()
        if n == before or not loose:
            break
        level, before = (full - held) / loose, n
    return ranked.withColumn("target", F.least(cap, F.col("weight") * level))


def _uniform(h: np.ndarray, level: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes, other ones at each level."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def pair(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """New probabilities of two documents of s and t words; at least one is 0 or 1."""
    up, down = min((1 - p) * s, q * t), min((1 - q) * t, p * s)
    if u * (up + down) < down:  # the first gains
        return (1.0, max(0.0, q - (1 - p) * s / t)) if (1 - p) * s <= q * t else (min(1.0, p + q * t / s), 0.0)
    return (max(0.0, p - (1 - q) * t / s), 1.0) if (1 - q) * t <= p * s else (0.0, min(1.0, q + p * s / t))


def _rounded(batches, level: int, last: bool):
    """Rows sorted by sid and bucket in; the same rows out, all but one of each bucket with p at 0
    or 1, and that one too if last. Columns sid, bucket, h, size, p come first."""
    held, held_p = None, 0.0  # a row of an earlier batch that still has a fraction

    def out(batch, p):
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(p, pa.float64()), *batch.columns[5:]], batch.schema.names)

    def settle(row, p):
        return float(_uniform(np.asarray(row.column(2)), level + 1000)[0] < p) if last and 0 < p < 1 else p

    for b in batches:
        if not b.num_rows:
            continue
        sid, bucket, h, size, p = (np.asarray(b.column(i)) for i in range(5))
        u = _uniform(h, level).tolist()
        sizes, p = size.astype(float).tolist(), p.tolist()
        key = list(zip(sid.tolist(), bucket.tolist(), strict=True))
        now = (held.column(0)[0].as_py(), held.column(1)[0].as_py()) if held is not None else None
        at = -1 if held is not None else None  # where the open fraction is
        for i, k in enumerate(key):
            if k != now or at is None:
                if k != now and at is not None:
                    if at < 0:
                        yield out(held, [settle(held, held_p)])
                        held = None
                    else:
                        p[at] = settle(b.slice(at, 1), p[at])
                now, at = k, i
                continue
            mine, s = (held_p, float(held.column(3)[0].as_py())) if at < 0 else (p[at], sizes[at])
            mine, p[i] = pair(mine, s, p[i], sizes[i], u[i])
            if at < 0:
                held_p = mine
            else:
                p[at] = mine
            if not 0 < mine < 1:
                if at < 0:
                    yield out(held, [held_p])
                    held = None
                at = i if 0 < p[i] < 1 else None
        if at is not None and at >= 0:
            held, held_p = b.slice(at, 1), p[at]
            if at:
                yield out(b.slice(0, at), p[:at])
            if at + 1 < b.num_rows:
                yield out(b.slice(at + 1), p[at + 1 :])
        else:
            yield out(b, p)
    if held is not None:
        yield out(held, [settle(held, held_p)])


def mix(docs: DataFrame, row: str = "row", weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) for every row of docs; ``row``
    names its column of row keys."""
    sized = materialize(docs.select(F.col(row).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sized")
    targets = materialize(source_targets(sized, weights, most), "mixing-targets")
    wish = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(targets.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "weight")
    repeated = sized.groupBy("doc_id").count().where(F.col("count") > BUCKET).select(F.col("doc_id").alias("doc_id_"), F.lit(True).alias("often"))
    joined = joined.join(repeated, F.col("doc_id").eqNullSafe(F.col("doc_id_")), "left").drop("doc_id_")
    h = F.xxhash64("doc_id", "size", F.when(F.col("often"), F.col("row")))
    buckets = F.ceil(F.col("source_rows") / BUCKET)
    rows = joined.select("sid", F.pmod(h, buckets).alias("bucket"), h.alias("h"), "size", (wish - F.floor(wish)).alias("p"), F.floor(wish).cast("int").alias("whole"), "row", "doc_id", "source", "source_size", "target")
    rows = materialize(rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0)), "mixing-rows")
    done = [rows.where("p <= 0 or p >= 1")]
    most_buckets, level = rows.agg(F.max("bucket")).first()[0], 0
    open_rows = rows.where("p > 0 and p < 1")
    while most_buckets is not None:
        last = most_buckets == 0
        dealt = open_rows.repartition("sid", "bucket").sortWithinPartitions("sid", "bucket", "h", "doc_id", "row")
        step = materialize(dealt.mapInArrow(lambda it, level=level, last=last: _rounded(it, level, last), T.StructType(rows.schema.fields)), "mixing-level")
        done.append(step.where("p <= 0 or p >= 1"))
        if last:
            break
        open_rows = step.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        most_buckets, level = most_buckets // FAN, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_key(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "row")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def take_copies(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay as they are."""
    row, n = free_name(docs, "row_key"), free_name(docs, "mix_copies")
    keyed = with_row_key(docs, row)
    taken = materialize(mix(keyed, row, weights, most).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n)), "mixing-taken")
    joined = keyed.join(taken, row)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
