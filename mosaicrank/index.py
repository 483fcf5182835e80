"""The index: train, add, search, remove, update, merge, over tables of a Store."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import postings as P
from .operators import quantizers as Q
from .operators.kmeans import CoarseQuantizer, as_matrix, train_kmeans
from .plans.planner import Context, candidates, plan
from .plans.query import Query, from_dict
from .session import ship
from .sources.frames import documents_frame
from .sources.schema import SPARK_TYPES, Configuration, Document, FieldRole, Schema, SearchOptions, Version
from .sources.store import Store

CONTEXT = "field string, doc_id bigint, codes array<int>, residuals binary"
SAMPLE_OVER = 100_000


class Index:
    def __init__(self, spark: SparkSession, path: str, schema: Schema, config: Configuration, read_only: bool = False):
        ship(spark)
        self.spark, self.path, self.schema, self.config, self.read_only = spark, path, schema, config, read_only
        self.store = Store(spark, path)
        clustered = [f for f in schema.fields if f.is_clustered]
        self.coarse = {f.name: CoarseQuantizer() for f in clustered}
        self.quantizers = {f.name: Q.make(f.parameters) for f in clustered}

    @staticmethod
    def create(spark: SparkSession, path: str, schema: Schema, config: Configuration | None = None) -> Index:
        schema.check_trainable()
        index = Index(spark, path, schema, config or Configuration())
        if index.store.exists("schema.json"):
            raise ValueError(f"{path} holds an index")
        index.save()
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, read_only: bool = False) -> Index:
        store = Store(spark, path)
        if not store.exists("schema.json"):
            raise FileNotFoundError(path)
        version = Version()
        if store.exists("metadata.json"):
            version = Version.parse(json.loads(store.read_text("metadata.json"))["version"])
        index = Index(spark, path, Schema.from_json(store.read_text("schema.json")), Configuration(version), read_only)
        if store.exists("models.json"):
            for name, m in json.loads(store.read_text("models.json")).items():
                index.coarse[name] = CoarseQuantizer(m["centroids"] or None)
                index.quantizers[name] = Q.from_dict(m["quantizer"])
        return index

    @staticmethod
    def copy_trained(other: Index, path: str) -> Index:
        """A new index with the other's schema and models, without documents."""
        index = Index.create(other.spark, path, other.schema, other.config)
        index.coarse, index.quantizers = dict(other.coarse), dict(other.quantizers)
        index.save()
        return index

    def save(self) -> None:
        self._writable()
        self.store.write_text("schema.json", self.schema.to_json())
        self.store.write_text("metadata.json", json.dumps({"version": str(self.config.version)}))
        self.store.write_text("models.json", json.dumps({n: {"centroids": c.centroids.tolist(), "quantizer": self.quantizers[n].to_dict()} for n, c in self.coarse.items()}))

    def flush(self) -> None:
        """Changes are on disk when a call returns."""

    close = flush

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("the index is open for reading")

    # training

    def tokens(self, docs: DataFrame | list[Document], name: str) -> DataFrame:
        """(doc_id, token_idx, v) of a tensor field."""
        frame = documents_frame(self.spark, self.schema, docs)
        return frame.select("doc_id", F.posexplode(name).alias("token_idx", "v"))

    def train(self, docs: DataFrame | list[Document]) -> None:
        """k-means on all tokens of each clustered field, then its quantizer on residuals; beyond
        SAMPLE_OVER tokens the quantizer sees floor(sqrt(n)) of them, by hash."""
        self._writable()
        for f in self.schema.fields:
            if not f.is_clustered:
                continue
            p = f.parameters
            if not p.num_centroids:
                raise ValueError(f"field {f.name} needs num_centroids")
            tokens = self.tokens(docs, f.name).where(F.size("v") == p.dimensions).select("v")
            coarse = self.coarse[f.name] = train_kmeans(tokens, p.num_centroids, p.num_iterations)
            n = tokens.count()
            sample = int(n**0.5) if n > SAMPLE_OVER else n
            picked = as_matrix(tokens.orderBy(F.xxhash64("v", F.lit(1234))).limit(sample).toArrow().column(0).combine_chunks())
            self.quantizers[f.name] = Q.make(p).train(coarse.residuals(picked))
        self.save()

    def set_coarse_quantizer(self, name: str, coarse: CoarseQuantizer | np.ndarray) -> None:
        self.schema[name]
        self.coarse[name] = coarse if isinstance(coarse, CoarseQuantizer) else CoarseQuantizer(coarse)
        self.save()

    def set_quantizer(self, name: str, quantizer) -> None:
        self.schema[name]
        self.quantizers[name] = quantizer
        self.save()

    # documents

    def _coded(self, frame: DataFrame, name: str) -> DataFrame:
        """(field, doc_id, codes, residuals): one numpy product for each batch of documents."""
        coarse, quantizer, back = self.coarse[name].require(), self.quantizers[name], self.schema[name].parameters.residual_mode == "residual"

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    tensors = part.column(1)
                    sizes = np.diff(np.asarray(tensors.offsets))
                    x = as_matrix(tensors.flatten())
                    own = coarse.assign(x) if len(x) else np.empty(0, np.int32)
                    data = quantizer.encode(x - coarse.centroids[own] if back else x) if len(x) else np.empty((0, 0), np.uint8)
                    stops = np.cumsum(sizes)
                    ranges = list(zip((stops - sizes).tolist(), stops.tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own[i:j] for i, j in ranges], pa.list_(pa.int32())), pa.array([data[i:j].tobytes() for i, j in ranges], pa.binary())], ["doc_id", "codes", "residuals"])

        rows = frame.where(F.col(name).isNotNull()).select("doc_id", F.col(name).cast("array<array<float>>"))
        return rows.mapInArrow(run, "doc_id bigint, codes array<int>, residuals binary").select(F.lit(name).alias("field"), "doc_id", "codes", "residuals")

    @property
    def _stored_schema(self) -> str | None:
        stored = [f for f in self.schema.fields if f.has(FieldRole.STORED)]
        return ", ".join(["doc_id bigint", *[f"`{f.name}` {SPARK_TYPES[f.data_type]}" for f in stored]]) if stored else None

    @property
    def _schemas(self) -> dict[str, str]:
        out = {"postings": P.POSTINGS, "context": CONTEXT}
        return out | ({"stored": self._stored_schema} if self._stored_schema else {})

    def add(self, tenant: int, docs: DataFrame | list[Document]) -> None:
        """Upserts documents. Of rows with one doc_id, one stays."""
        self._writable()
        frame = documents_frame(self.spark, self.schema, docs).where("doc_id is not null").dropDuplicates(["doc_id"])
        parts, contexts, tables = P.scalar_postings(frame, self.schema), [], {}
        for f in self.schema.fields:
            if not f.is_clustered:
                continue
            coded = self._coded(frame, f.name)
            parts.append(P.centroid_postings(coded, f.name))
            if f.has(FieldRole.COLBERT, FieldRole.CONTEXT):
                contexts.append(coded)
        union = lambda xs: xs[0] if len(xs) == 1 else union([xs[0].unionByName(xs[1]), *xs[2:]])
        if parts:
            tables["postings"] = union(parts)
        if contexts:
            tables["context"] = union(contexts)
        if self._stored_schema:
            tables["stored"] = frame.select("doc_id", *[f.name for f in self.schema.fields if f.has(FieldRole.STORED)])
        self.store.append(tenant, tables, frame.select("doc_id"))

    def add_single(self, tenant: int, doc: Document) -> None:
        self.add(tenant, [doc])

    def remove(self, tenant: int, ids: list[int] | DataFrame) -> None:
        self._writable()
        doomed = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
        self.store.append(tenant, {}, doomed)

    def update(self, tenant: int, docs: DataFrame | list[Document]) -> None:
        self.add(tenant, docs)

    def compact(self, tenant: int) -> None:
        self._writable()
        self.store.compact(tenant, self._schemas)

    def merge(self, other: Index | str, force: bool = False) -> None:
        """Upserts all documents of another index; versions and centroids must agree (force skips
        the centroids)."""
        self._writable()
        other = Index.open(self.spark, other, True) if isinstance(other, str) else other
        if str(other.config.version) != str(self.config.version):
            raise ValueError("the versions differ")
        same = all(n in other.coarse and np.array_equal(c.centroids, other.coarse[n].centroids) for n, c in self.coarse.items())
        if not same and not force:
            raise ValueError("the centroids differ")
        for tenant in other.store.tenants():
            tables = {n: other.store.read(tenant, n, s) for n, s in other._schemas.items() if n in self._schemas}
            ids = [t.select("doc_id") for t in tables.values()]
            every = ids[0]
            for i in ids[1:]:
                every = every.unionByName(i)
            self.store.append(tenant, tables, every)

    # reading

    def postings(self, tenant: int) -> DataFrame:
        return self.store.read(tenant, "postings", P.POSTINGS)

    def get_mapping(self, tenant: int, name: str) -> DataFrame:
        return P.mapping(self.postings(tenant), name)

    def get_metadata(self, tenant: int, ids: list[int]) -> DataFrame:
        """Stored columns of ids; null where nothing is stored."""
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
        return wanted.join(self.stored(tenant), "doc_id", "left") if self._stored_schema else wanted

    def stored(self, tenant: int) -> DataFrame:
        return self.store.read(tenant, "stored", self._stored_schema)

    def context(self, tenant: int) -> Context:
        stored = self.stored(tenant) if self._stored_schema else None
        return Context(self.schema, self.postings(tenant), self.store.read(tenant, "context", CONTEXT), stored, self.coarse, self.quantizers)

    def search(self, tenant: int, query: Query | dict, k: int, options: SearchOptions | dict | None = None) -> DataFrame:
        """(doc_id, score, stored columns), best first."""
        opts = SearchOptions(**options) if isinstance(options, dict) else options or SearchOptions()
        root = query.root if isinstance(query, Query) else from_dict(query, {f.name: f.parameters.dimensions for f in self.schema.fields})
        return plan(root, k, self.context(tenant), opts)

    def explain_doc(self, tenant: int, query: Query, doc_id: int, options: SearchOptions | None = None) -> DataFrame:
        """The first-pass row of one document, empty if it's no candidate."""
        return candidates(query.root, self.context(tenant), options or SearchOptions()).where(F.col("doc_id") == doc_id)
