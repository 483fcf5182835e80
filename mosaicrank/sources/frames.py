"""Documents as rows: tenant-less frames of doc_id and one column for each field."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SPARK_TYPES, DataType, Document, Field, Schema, millis


def validate(schema: Schema, docs: Iterable[Document]) -> None:
    for d in docs:
        for v in d.fields:
            f = schema[v.name]
            if f.data_type != v.data_type:
                raise ValueError(f"field {v.name} of document {d.id} has the wrong type")


def documents_frame(spark: SparkSession, schema: Schema, docs: DataFrame | list[Document]) -> DataFrame:
    """doc_id and a column for each field of the schema; a field that isn't supplied is null.
    Timestamps are cut to milliseconds. A frame's own columns are cast."""
    if isinstance(docs, DataFrame):
        unknown = [c for c in docs.columns if c != "doc_id" and all(f.name != c for f in schema.fields)]
        if unknown:
            raise ValueError(f"no fields {unknown}")
        column = lambda f: (F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(SPARK_TYPES[f.data_type]).alias(f.name)
        out = docs.select(F.col("doc_id").cast("bigint"), *[column(f) for f in schema.fields])
    else:
        docs = list(docs)
        validate(schema, docs)
        rows = []
        for d in docs:
            given = {v.name: v.value for v in d.fields}
            rows.append((d.id, *[millis(given[f.name]) if f.data_type is DataType.DATETIME and f.name in given else given.get(f.name) for f in schema.fields]))
        kinds = ", ".join(["doc_id bigint", *[f"`{f.name}` {'bigint' if f.data_type is DataType.DATETIME else SPARK_TYPES[f.data_type]}" for f in schema.fields]])
        out = spark.createDataFrame(rows, kinds)
        for f in schema.fields:
            if f.data_type is DataType.DATETIME:
                out = out.withColumn(f.name, F.timestamp_millis(f.name))
    for f in schema.fields:
        if f.data_type is DataType.DATETIME:
            out = out.withColumn(f.name, F.timestamp_millis(F.unix_millis(f.name)))
    return out


def read_json_documents(spark: SparkSession, schema: Schema, path: str) -> DataFrame:
    """One document in JSON a line, parsed by Spark."""
    kind = "id bigint, fields array<struct<name string, data_type string, num_tensors int, value string>>"
    parsed = spark.read.text(path).select(F.from_json("value", kind).alias("d")).select("d.*").where("id is not null")

    def column(f: Field) -> Column:
        raw = F.get(F.filter("fields", lambda x: x["name"] == f.name), 0)["value"]
        if f.is_tensor:
            flat, d = F.from_json(raw, "array<float>"), max(f.parameters.dimensions, 1)
            rows = F.transform(F.sequence(F.lit(0), (F.size(flat) / d).cast("int") - 1), lambda i: F.slice(flat, i * d + 1, d))
            return F.when(F.size(flat) >= d, rows)
        return F.timestamp_millis(raw.cast("bigint")) if f.data_type is DataType.DATETIME else raw.cast(SPARK_TYPES[f.data_type])

    return documents_frame(spark, schema, parsed.select(F.col("id").alias("doc_id"), *[column(f).alias(f.name) for f in schema.fields]))


def to_json_rows(results: DataFrame) -> DataFrame:
    """Results as JSON: id, score and metadata."""
    meta = [c for c in results.columns if c not in ("doc_id", "score", "rank")]
    return results.select(F.to_json(F.struct(F.col("doc_id").alias("id"), "score", F.struct(*meta).alias("metadata") if meta else F.lit("{}").alias("metadata"))).alias("value"))
