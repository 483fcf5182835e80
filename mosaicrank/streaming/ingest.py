"""Documents from a stream: each micro-batch is an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..index import Index


def ingest(stream: DataFrame, index: Index, tenant: int, checkpoint: str, trigger: dict | None = None):
    """Starts the stream. A batch that runs again upserts the same documents, so nothing doubles."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.add(tenant, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
