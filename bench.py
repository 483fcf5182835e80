"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then three times; the median of these is its figure. recall_at_10
is that of the self-trained search against brute force.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

import numpy as np

from mosaicrank import catalog
from mosaicrank.session import local_session

QUERIES = ["mv_brute_maxsim_topk", "mv_brute_maxsim_kernel", "plaid_centroid_score", "two_phase_search", "search_and_filter", "search_with_metadata", "batch_search", "ivf_postings", "binarizer_weights", "pq_encode"]


def timed(f) -> float:
    f()
    took = []
    for _ in range(3):
        t = time.perf_counter()
        f()
        took.append(time.perf_counter() - t)
    return round(statistics.median(took), 3)


def engine(spark, sf_dir: str) -> tuple[dict[str, float], float]:
    """Training, adding and searching a stored index of five tokens a document; and recall@10."""
    from pyspark.sql import functions as F

    from mosaicrank.index import Index
    from mosaicrank.operators.scoring import max_sim
    from mosaicrank.plans.query import Query, VectorQueryNode
    from mosaicrank.sources import schema as T

    tokens = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    docs = tokens.groupBy(F.expr("vec_id div 5").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t")).select("doc_id", F.col("t.embedding").alias("colbert")).cache()
    n, out = docs.count(), {}
    p = T.FieldParameters(dimensions=64, quantization=T.QuantizerType.NONE, num_centroids=32, num_iterations=5)
    index = Index.create(spark, tempfile.mkdtemp(prefix="bench-") + "/index", T.Schema([T.ColbertField("colbert", T.DataType.TENSOR, p)]))
    t = time.perf_counter()
    index.train(docs)
    out["index_train"] = round(time.perf_counter() - t, 3)
    t = time.perf_counter()
    index.add(0, docs)
    out["index_add"] = round(time.perf_counter() - t, 3)
    every = {r["doc_id"]: r["colbert"] for r in docs.collect()}
    hits, opts = 0, T.SearchOptions(n_probe=16, k_top_centroids=8)
    asked = sorted(every)[:: max(1, n // 5)][:5]
    search = lambda i: index.search(0, Query(VectorQueryNode(T.tensor("colbert", every[i]))), 10, opts).collect()
    for i in asked:
        best = sorted(every, key=lambda j: (-max_sim(np.array(every[i]), np.array(every[j])), j))[:10]
        hits += len(set(best) & {r["doc_id"] for r in search(i)})
    out["index_search"] = timed(lambda: search(asked[0]))
    return out, round(hits / (10 * len(asked)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), shuffle_partitions=8)
    took = {}
    for name in QUERIES:
        took[name] = timed(lambda f=catalog.QUERIES[name]: f(spark, sf_dir).collect())
        print(name, took[name], file=sys.stderr, flush=True)
    more, recall = engine(spark, sf_dir)
    took |= more
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "recall_at_10": recall}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
