"""From a query tree to one lazy DataFrame.

Probing happens on the driver, on the query's few tokens and the centroids. The rest is a plan of
a semi-join's worth of posting filters, one context join that reads codes alone, a top-n, a
second join for at most num_second_pass residuals (None: all candidates'), a top-k and a left join
for what is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postings as P
from ..operators import scoring as S
from ..operators.kmeans import CoarseQuantizer
from ..sources.schema import FieldRole, Schema, SearchOptions
from .query import AndQueryNode, OrQueryNode, TermQueryNode, VectorQueryNode, vectors


def probed(table: np.ndarray, k_top: int, n_probe: int) -> list[tuple[int, float]]:
    """Centroids to probe with their scores: of each query token's k_top best those with a
    positive best score, the n_probe best, ties to smaller ids."""
    best: dict[int, float] = {}
    for row in table:
        for c in np.argsort(-row, kind="stable")[: min(k_top, table.shape[1])]:
            best[int(c)] = max(best.get(int(c), 0.0), float(row[c]))
    return sorted(((c, s) for c, s in best.items() if s > 0), key=lambda x: (-x[1], x[0]))[:n_probe]


@dataclass
class Context:
    """What a plan reads: a tenant's tables and the models of its fields."""

    schema: Schema
    postings: DataFrame
    context: DataFrame  # field, doc_id, codes, residuals
    stored: DataFrame | None
    coarse: dict[str, CoarseQuantizer]
    quantizers: dict[str, object]

    def none(self) -> DataFrame:
        return self.postings.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))


def candidates(node, ctx: Context, opts: SearchOptions) -> DataFrame:
    """(doc_id, score of the first pass) of the documents that match a node."""
    if isinstance(node, TermQueryNode):
        v = node.value
        return P.scan(ctx.postings, P.term_filter(ctx.schema, v.name, v.data_type, v.value)).withColumn("score", F.lit(1.0))
    if isinstance(node, VectorQueryNode):
        f = ctx.schema[node.value.name]
        if not f.is_clustered:
            return ctx.none()
        table = node.matrix.astype(float) @ ctx.coarse[f.name].require().centroids.T
        picks = probed(table, opts.k_top_centroids, opts.n_probe)
        if not picks:
            return ctx.none()
        found = P.probe(ctx.postings, f.name, [c for c, _ in picks])
        if node.method == "one":
            return found.withColumn("score", F.lit(1.0))
        if not ctx.schema[opts.colbert_field].has(FieldRole.COLBERT) or opts.colbert_field != f.name:
            return found.withColumn("score", F.lit(0.0))  # no context of the probed kind
        codes = ctx.context.where(F.col("field") == f.name).select("doc_id", "codes")
        return found.join(codes, "doc_id", "left").select("doc_id", S.plaid_column(table).alias("score"))
    if isinstance(node, AndQueryNode | OrQueryNode):
        parts = [candidates(c, ctx, opts) for c in node.children]
        if not parts:
            return ctx.none()
        return (P.intersect if isinstance(node, AndQueryNode) else P.unite)(parts, node.method)
    raise ValueError(f"no query node {type(node).__name__}")


def plan(root, k: int, ctx: Context, opts: SearchOptions) -> DataFrame:
    """(doc_id, score, stored columns), best first: at most k rows."""
    opts.check()
    found = candidates(root, ctx, opts)
    first = (found if opts.num_second_pass is None else S.top(found, max(opts.num_second_pass, 0))).select("doc_id")
    probes = [v for v in vectors(root) if v.value.name == opts.colbert_field]
    f = ctx.schema[opts.colbert_field] if probes or vectors(root) else None
    if not probes or not f.has(FieldRole.COLBERT):
        scored = first.withColumn("score", F.lit(0.0))
    else:
        back = ctx.coarse[f.name].centroids if f.parameters.residual_mode == "residual" else None
        tokens = ctx.context.where(F.col("field") == f.name).select("doc_id", "codes", "residuals")
        score = S.maxsim_column(probes[0].matrix, ctx.quantizers[f.name], back)
        scored = first.join(tokens, "doc_id", "left").select("doc_id", score.alias("score"))
    best = S.top(scored, max(k, 0))
    if ctx.stored is None:
        return best
    return best.join(ctx.stored, "doc_id", "left").orderBy(F.desc("score"), "doc_id")
