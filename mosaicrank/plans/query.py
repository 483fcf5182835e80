"""Query trees: terms, vectors, and, or. A tree is a logical plan; planner.py makes it a frame."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..sources.schema import DataType, FieldValue


@dataclass
class TermQueryNode:
    value: FieldValue


@dataclass
class VectorQueryNode:
    value: FieldValue
    method: str = "plaid"  # or "one"

    @property
    def matrix(self) -> np.ndarray:
        return np.atleast_2d(np.asarray(self.value.value, np.float32))


@dataclass
class AndQueryNode:
    children: list = field(default_factory=list)
    method: str = "sum"

    def add_child(self, node) -> None:
        self.children.append(node)


@dataclass
class OrQueryNode:
    children: list = field(default_factory=list)
    method: str = "sum"

    def add_child(self, node) -> None:
        self.children.append(node)


@dataclass
class Query:
    root: object


def vectors(node) -> list[VectorQueryNode]:
    """All vector nodes, left to right."""
    if isinstance(node, VectorQueryNode):
        return [node]
    return [v for c in getattr(node, "children", []) for v in vectors(c)]


def from_dict(x: dict, dimensions: dict[str, int] | None = None):
    kind = x["type"]
    if kind == "TERM":
        return TermQueryNode(FieldValue.from_dict(x["value"]))
    if kind in ("TENSOR", "VECTOR"):
        one = {"name": x["name"], "data_type": DataType.TENSOR.name, "value": x["value"]} | ({"num_tensors": x["num_tensors"]} if x.get("num_tensors") else {})
        return VectorQueryNode(FieldValue.from_dict(one, (dimensions or {}).get(x["name"], 0)))
    if kind in ("AND", "OR"):
        return (AndQueryNode if kind == "AND" else OrQueryNode)([from_dict(c, dimensions) for c in x["children"]], x.get("method", "sum"))
    raise ValueError(f"no query node {kind}")
