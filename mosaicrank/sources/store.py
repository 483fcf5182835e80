"""An index on disk: segments of Parquet, tombstones, and a manifest in JSON.

Every change writes a new segment and then a new manifest, so readers see whole changes and a lost
job leaves only files that no manifest names. A tombstone hides rows of older segments; compact()
folds segments into one. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("postings", "context", "stored")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(name)
        return fs.exists(p)

    def write_text(self, name: str, text: str) -> None:
        fs, p = self._fs(name)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    @property
    def manifest(self) -> dict:
        """The newest manifest: {"seq", "segments": [{"seq", "tenant", "dir", "tables"}], "tombstones": [...]}."""
        fs, p = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return json.loads(self.read_text(f"manifests/{max(numbers)}.json")) if numbers else {"seq": 0, "segments": [], "tombstones": []}

    def commit(self, manifest: dict) -> None:
        self.write_text(f"manifests/{manifest['seq']}.json", json.dumps(manifest))

    def append(self, tenant: int, tables: dict[str, DataFrame], doomed: DataFrame | None = None) -> None:
        """Adds a segment of a tenant; older rows of the doc_ids in doomed are hidden."""
        m = self.manifest
        seq, where = m["seq"] + 1, f"segments/{uuid.uuid4().hex}"
        for name, df in tables.items():
            writer = df.write
            (writer.partitionBy("field") if name == "postings" else writer).parquet(f"{self.path}/{where}/{name}")
        if tables:
            m["segments"].append({"seq": seq, "tenant": tenant, "dir": where, "tables": sorted(tables)})
        if doomed is not None:
            where = f"tombstones/{uuid.uuid4().hex}"
            doomed.select("doc_id").distinct().write.parquet(f"{self.path}/{where}")
            m["tombstones"].append({"seq": seq, "tenant": tenant, "dir": where})
        self.commit(m | {"seq": seq})

    def tenants(self) -> list[int]:
        return sorted({s["tenant"] for s in self.manifest["segments"]})

    def read(self, tenant: int, table: str, schema: str) -> DataFrame:
        """The tenant's live rows."""
        m = self.manifest
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s['dir']}/{table}").withColumn("seq", F.lit(s["seq"])) for s in m["segments"] if s["tenant"] == tenant and table in s["tables"]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, parts)
        first = min(s["seq"] for s in m["segments"] if s["tenant"] == tenant)
        dead = [self.spark.read.schema("doc_id bigint").parquet(f"{self.path}/{t['dir']}").withColumn("dead", F.lit(t["seq"])) for t in m["tombstones"] if t["tenant"] == tenant and t["seq"] > first]
        if dead:
            last = reduce(DataFrame.unionByName, dead).groupBy("doc_id").agg(F.max("dead").alias("dead"))
            rows = rows.join(last, "doc_id", "left").where("dead is null or seq >= dead").drop("dead")
        return rows.select(*self.spark.createDataFrame([], schema).columns)

    def compact(self, tenant: int, schemas: dict[str, str]) -> None:
        """Rewrites a tenant's live rows as one segment without tombstones."""
        m = self.manifest
        seq, where, tables = m["seq"] + 1, f"segments/{uuid.uuid4().hex}", []
        for name, schema in schemas.items():
            if any(name in s["tables"] for s in m["segments"] if s["tenant"] == tenant):
                writer = self.read(tenant, name, schema).write
                (writer.partitionBy("field") if name == "postings" else writer).parquet(f"{self.path}/{where}/{name}")
                tables.append(name)
        keep = lambda xs: [x for x in xs if x["tenant"] != tenant]
        segments = keep(m["segments"]) + ([{"seq": seq, "tenant": tenant, "dir": where, "tables": tables}] if tables else [])
        self.commit({"seq": seq, "segments": segments, "tombstones": keep(m["tombstones"])})
