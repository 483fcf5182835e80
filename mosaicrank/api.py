"""JSON in, JSON out: the shape of an HTTP service, without the server."""

from __future__ import annotations

from .index import Index
from .plans.query import Query, from_dict
from .sources.frames import to_json_rows
from .sources.schema import Document, SearchOptions


def search_json(index: Index, tenant: int, body: dict) -> dict:
    """body: {"query": tree, "k": n, "options": {...}}."""
    try:
        root = from_dict(body["query"], {f.name: f.parameters.dimensions for f in index.schema.fields})
        found = index.search(tenant, Query(root), int(body.get("k", 10)), SearchOptions(**body.get("options", {})))
        return {"ok": True, "results": [r[0] for r in to_json_rows(found).collect()]}  # at most k rows
    except (KeyError, TypeError, ValueError, RuntimeError) as e:
        return {"ok": False, "error": str(e)}


def _documents(index: Index, body: dict) -> list[Document]:
    return [Document.from_dict(d, index.schema) for d in body["docs"]]


def add_json(index: Index, tenant: int, body: dict) -> dict:
    try:
        index.add(tenant, _documents(index, body))
        return {"ok": True}
    except (KeyError, TypeError, ValueError, RuntimeError) as e:
        return {"ok": False, "error": str(e)}


def update_json(index: Index, tenant: int, body: dict) -> dict:
    return add_json(index, tenant, body)


def remove_json(index: Index, tenant: int, body: dict) -> dict:
    try:
        index.remove(tenant, [int(i) for i in body["ids"]])
        return {"ok": True}
    except (KeyError, TypeError, ValueError, RuntimeError) as e:
        return {"ok": False, "error": str(e)}
