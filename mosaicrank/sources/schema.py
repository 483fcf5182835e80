"""Declared types: fields, schemas, values, documents, options, and their JSON.

Enums are written as integers in a schema and as names in a value. Field values are checked
against the schema before anything is written.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from enum import Enum, IntEnum
from typing import Any

import numpy as np


class DataType(Enum):
    TENSOR = 0
    QUANTIZED_TENSOR = 1
    INTEGER = 2
    FLOAT = 3
    TEXT = 4
    DATETIME = 5
    TENSOR_FLOAT16 = 6
    FLOAT16 = 7
    COLBERT = 8


TENSORS = {DataType.TENSOR, DataType.TENSOR_FLOAT16}
SPARK_TYPES = {
    DataType.TENSOR: "array<array<float>>",
    DataType.TENSOR_FLOAT16: "array<array<float>>",
    DataType.QUANTIZED_TENSOR: "binary",
    DataType.INTEGER: "bigint",
    DataType.FLOAT: "float",
    DataType.FLOAT16: "float",
    DataType.TEXT: "string",
    DataType.DATETIME: "timestamp",
}


class FieldRole(IntEnum):
    INDEXED = 0
    CONTEXT = 1
    STORED = 2
    COLBERT = 3


class QuantizerType(IntEnum):
    UNKNOWN = 0
    NONE = 1
    BINARIZER = 2
    PRODUCT_ENCODER = 3


@dataclass
class FieldParameters:
    dimensions: int = 0
    analyzer: str = ""
    quantization: QuantizerType = QuantizerType.UNKNOWN
    num_centroids: int = 0
    num_iterations: int = 10
    num_subquantizers: int = 0
    nbits: int = 1
    residual_mode: str = "raw"  # "raw" codes vectors themselves, "residual" what the centroid leaves
    quantile_source: str = "dim_means"  # or "values"


@dataclass
class Field:
    name: str
    data_type: DataType
    roles: list[FieldRole] = field(default_factory=list)
    parameters: FieldParameters = field(default_factory=FieldParameters)

    def add_role(self, role: FieldRole) -> Field:
        self.roles.append(role)
        return self

    def has(self, *roles: FieldRole) -> bool:
        return any(r in self.roles for r in roles)

    @property
    def is_tensor(self) -> bool:
        return self.data_type in TENSORS

    @property
    def is_clustered(self) -> bool:
        return self.is_tensor and self.has(FieldRole.INDEXED, FieldRole.COLBERT)


def _with_role(role: FieldRole):
    def make(name: str, data_type: DataType, parameters: FieldParameters | None = None) -> Field:
        return Field(name, data_type, [role], parameters or FieldParameters())

    return make


IndexedField, ContextField, StoredField, ColbertField = (_with_role(r) for r in (FieldRole.INDEXED, FieldRole.CONTEXT, FieldRole.STORED, FieldRole.COLBERT))


@dataclass
class Schema:
    fields: list[Field] = field(default_factory=list)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("a field name occurs twice")

    def add_field(self, f: Field) -> None:
        if any(g.name == f.name for g in self.fields):
            raise ValueError(f"field {f.name} exists")
        self.fields.append(f)

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"no field {name}")

    def check_trainable(self) -> None:
        for f in self.fields:
            if f.is_clustered and f.parameters.quantization == QuantizerType.UNKNOWN:
                raise ValueError(f"field {f.name} needs a quantization type")

    def to_json(self) -> str:
        out = [{"name": f.name, "data_type": f.data_type.value, "roles": [int(r) for r in f.roles], "parameters": asdict(f.parameters)} for f in self.fields]
        return json.dumps({"fields": out})

    @staticmethod
    def from_json(text: str) -> Schema:
        fields = []
        for x in json.loads(text)["fields"]:
            p = dict(x.get("parameters", {}))
            p["quantization"] = QuantizerType(p.get("quantization", 0))
            fields.append(Field(x["name"], DataType(x["data_type"]), [FieldRole(r) for r in x["roles"]], FieldParameters(**p)))
        return Schema(fields)


def millis(value: datetime | int) -> int:
    """Milliseconds since 1970; finer parts are cut."""
    if isinstance(value, int):
        return value
    aware = value if value.tzinfo else value.replace(tzinfo=UTC)
    d = aware - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86_400_000) + d.seconds * 1000 + d.microseconds // 1000


@dataclass
class FieldValue:
    name: str
    data_type: DataType
    value: Any

    @property
    def num_tensors(self) -> int:
        return len(self.value) if self.data_type in TENSORS else 0

    def to_dict(self) -> dict:
        value = self.value
        out: dict = {"name": self.name, "data_type": self.data_type.name}
        if self.data_type in TENSORS:
            value = [float(x) for row in value for x in row]
            out["num_tensors"] = self.num_tensors
        elif self.data_type is DataType.DATETIME:
            value = millis(value)
        return out | {"value": value}

    @staticmethod
    def from_dict(x: dict, dimensions: int = 0) -> FieldValue:
        kind, value = DataType[x["data_type"]], x["value"]
        if kind in TENSORS:
            flat = np.asarray(value, np.float32)
            if flat.ndim == 1:
                rows = x.get("num_tensors") or (len(flat) // dimensions if dimensions else 1)
                flat = flat.reshape(rows, -1)
            value = flat.tolist()
        return FieldValue(x["name"], kind, value)


def tensor(name: str, value) -> FieldValue:
    """From a 2-D array, or one vector."""
    a = np.asarray(value, np.float32)
    return FieldValue(name, DataType.TENSOR, a.reshape(1, -1).tolist() if a.ndim == 1 else a.tolist())


def integer(name: str, value: int) -> FieldValue:
    return FieldValue(name, DataType.INTEGER, int(value))


def real(name: str, value: float) -> FieldValue:
    return FieldValue(name, DataType.FLOAT, float(value))


def real16(name: str, value: float) -> FieldValue:
    return FieldValue(name, DataType.FLOAT16, float(value))


def text(name: str, value: str) -> FieldValue:
    return FieldValue(name, DataType.TEXT, value)


def date(name: str, value: datetime | int) -> FieldValue:
    return FieldValue(name, DataType.DATETIME, value)


def quantized_tensor(name: str, value: bytes) -> FieldValue:
    return FieldValue(name, DataType.QUANTIZED_TENSOR, bytes(value))


@dataclass
class Document:
    id: int
    fields: list[FieldValue] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"id": self.id, "fields": [f.to_dict() for f in self.fields]})

    @staticmethod
    def from_dict(x: dict, schema: Schema | None = None) -> Document:
        dims = lambda n: schema[n].parameters.dimensions if schema and any(f.name == n for f in schema.fields) else 0
        return Document(int(x["id"]), [FieldValue.from_dict(v, dims(v["name"])) for v in x["fields"]])

    @staticmethod
    def from_json(s: str, schema: Schema | None = None) -> Document:
        return Document.from_dict(json.loads(s), schema)


@dataclass
class SearchOptions:
    k_top_centroids: int = 2
    n_probe: int = 32
    num_second_pass: int | None = 1024  # None: every candidate is ranked
    colbert_field: str = "colbert"
    expected_id: int = -1

    def check(self) -> None:
        if self.n_probe <= 0 or self.k_top_centroids <= 0:
            raise ValueError("n_probe and k_top_centroids must be positive")


@dataclass(frozen=True, order=True)
class Version:
    major: int = 0
    minor: int = 0
    revision: int = 0

    @staticmethod
    def parse(s: str) -> Version:
        return Version(*[int(x) for x in s.split(".")])

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.revision}"


@dataclass
class Configuration:
    version: Version = Version(0, 1, 0)
