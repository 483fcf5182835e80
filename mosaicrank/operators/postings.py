"""Posting lists: which documents hold a term or a centroid.

One row for each (field, term, document). A term stands in the column of its kind: text in
``text``, integers, milliseconds and centroids in ``num``, floats in ``real``. Parquet partitions by
tenant and field; equality on a term reaches the scan as a pushed filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DataType, FieldRole, Schema, millis

POSTINGS = "field string, kind string, text string, num bigint, real double, doc_id bigint"
_KINDS = {DataType.TEXT: "text", DataType.INTEGER: "int", DataType.FLOAT: "real", DataType.DATETIME: "date"}


def _rows(docs: DataFrame, name: str, kind: str, keep: Column, **terms: Column) -> DataFrame:
    cast = {"text": "string", "num": "bigint", "real": "double"}
    columns = [(terms[c] if c in terms else F.lit(None)).cast(t).alias(c) for c, t in cast.items()]
    return docs.where(keep).select(F.lit(name).alias("field"), F.lit(kind).alias("kind"), *columns, "doc_id")


def scalar_postings(docs: DataFrame, schema: Schema) -> list[DataFrame]:
    """A frame for each indexed scalar field; a null value gives no posting."""
    out = []
    for f in schema.fields:
        if not f.has(FieldRole.INDEXED) or f.is_tensor:
            continue
        kind, c = _KINDS.get(f.data_type), F.col(f.name)
        if kind is None:
            raise ValueError(f"a field of type {f.data_type.name} can't be indexed")
        term = {"text": {"text": c}, "int": {"num": c}, "real": {"real": c.cast("double")}, "date": {"num": F.unix_millis(c) if kind == "date" else c}}[kind]
        out.append(_rows(docs, f.name, kind, c.isNotNull(), **term))
    return out


def centroid_postings(coded: DataFrame, name: str) -> DataFrame:
    """From rows of doc_id and codes (centroids, token by token): one row for each distinct one."""
    each = coded.select("doc_id", F.explode(F.array_distinct("codes")).alias("num"))
    return _rows(each, name, "centroid", F.lit(True), num=F.col("num"))


def term_filter(schema: Schema, name: str, data_type: DataType, value) -> Column:
    """Equality on one field's term. A tensor has no term; a type other than the field's, or a
    field that isn't indexed, matches nothing."""
    f = schema[name]
    if data_type not in _KINDS:
        raise ValueError(f"no term of type {data_type.name}")
    if f.data_type != data_type or not f.has(FieldRole.INDEXED):
        return F.lit(False)
    kind = _KINDS[data_type]
    here = (F.col("field") == name) & (F.col("kind") == kind)
    if kind == "text":
        return here & (F.col("text") == F.lit(value))
    if kind == "real":
        return here & (F.col("real") == F.lit(float(value)).cast("float").cast("double"))
    return here & (F.col("num") == F.lit(millis(value) if kind == "date" else int(value)))


def scan(postings: DataFrame, condition: Column) -> DataFrame:
    return postings.where(condition).select("doc_id").distinct()


def probe(postings: DataFrame, name: str, centroids: list[int]) -> DataFrame:
    """Documents with a token in one of a few centroids."""
    return scan(postings, (F.col("field") == name) & (F.col("kind") == "centroid") & F.col("num").isin([int(c) for c in centroids]))


def mapping(postings: DataFrame, name: str) -> DataFrame:
    """(doc_id, centroids sorted) of a field."""
    return postings.where((F.col("field") == name) & (F.col("kind") == "centroid")).groupBy("doc_id").agg(F.array_sort(F.collect_set("num")).alias("centroids"))


COMBINE = {"sum": lambda c: F.sum(c), "product": lambda c: F.product(c), "max": lambda c: F.max(c)}


def intersect(children: list[DataFrame], method: str = "sum") -> DataFrame:
    """Documents of all children, (doc_id, score) each; their scores combine."""
    if not children:
        raise ValueError("no children")
    named = [c.select("doc_id", F.col("score").alias(f"s{i}")) for i, c in enumerate(children)]
    joined = reduce(lambda a, b: a.join(b, "doc_id"), named)
    s = [F.col(f"s{i}") for i in range(len(children))]
    score = F.greatest(*s) if method == "max" and len(s) > 1 else reduce((lambda a, b: a * b) if method == "product" else (lambda a, b: a + b), s)
    return joined.select("doc_id", (s[0] if len(s) == 1 else score).alias("score"))


def unite(children: list[DataFrame], method: str = "sum") -> DataFrame:
    """Documents of any child; the scores of those that have it combine."""
    if not children:
        raise ValueError("no children")
    return reduce(DataFrame.unionByName, [c.select("doc_id", "score") for c in children]).groupBy("doc_id").agg(COMBINE[method]("score").alias("score"))
