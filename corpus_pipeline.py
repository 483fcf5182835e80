"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is a written table. All but
the last return the columns of docs. Each works on all that the one before kept:

- toxicity: documents that the positive-unlabelled classifier rejects go,
- line_dedup: lines that an earlier line matches go from their texts; n_chars follows,
- simhash: one document of each group of near-duplicates stays,
- mixing: each document stays as often as the mix of sources takes it,
- bpe: token counts and digests of what is left.

No SQL expresses the classifier, the fingerprints, the random rounding or BPE, so ORACLE_SQL is
None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicrank.llm.bpe import encode_documents, tokenizer_spec
from mosaicrank.llm.common import materialize, read
from mosaicrank.llm.line_dedup import dedup_lines
from mosaicrank.llm.mixing import take_copies
from mosaicrank.llm.simhash import keep_one_of_each
from mosaicrank.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_copies(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs.select("doc_id", "text"), tokenizer_spec())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("bpe", bpe)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
