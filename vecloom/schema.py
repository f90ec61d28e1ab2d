"""Declared schemas of vector datasets: a StructType whose fields carry their constraints as metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class Kind(str, Enum):
    """Logical types of a field."""

    INT8 = "int8"
    INT16 = "int16"
    INT32 = "int32"
    INT64 = "int64"
    FLOAT = "float"
    DOUBLE = "double"
    BOOL = "bool"
    STRING = "string"
    VARCHAR = "varchar"
    JSON = "json"
    ARRAY = "array"
    FLOAT_VECTOR = "float_vector"
    BINARY_VECTOR = "binary_vector"
    FLOAT16_VECTOR = "float16_vector"
    BFLOAT16_VECTOR = "bfloat16_vector"
    SPARSE_FLOAT_VECTOR = "sparse_float_vector"


_SPARK = {
    Kind.INT8: T.ByteType(),
    Kind.INT16: T.ShortType(),
    Kind.INT32: T.IntegerType(),
    Kind.INT64: T.LongType(),
    Kind.FLOAT: T.FloatType(),
    Kind.DOUBLE: T.DoubleType(),
    Kind.BOOL: T.BooleanType(),
    Kind.STRING: T.StringType(),
    Kind.VARCHAR: T.StringType(),
    Kind.JSON: T.StringType(),
    Kind.FLOAT_VECTOR: T.ArrayType(T.FloatType()),
    Kind.BINARY_VECTOR: T.BinaryType(),
    Kind.FLOAT16_VECTOR: T.BinaryType(),
    Kind.BFLOAT16_VECTOR: T.BinaryType(),
    Kind.SPARSE_FLOAT_VECTOR: T.MapType(T.IntegerType(), T.FloatType()),
}
#: A sparse vector may also be a pair of lists.
SPARSE_PAIR = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])
DENSE = {Kind.FLOAT_VECTOR, Kind.BINARY_VECTOR, Kind.FLOAT16_VECTOR, Kind.BFLOAT16_VECTOR}
_KEY = "vecloom"


@dataclass(frozen=True)
class Field:
    """A column. dim holds for dense vectors, max_length for VARCHAR (also as an array's element), max_capacity for arrays."""

    name: str
    kind: Kind
    dim: int | None = None
    max_length: int | None = None
    max_capacity: int | None = None
    element: Kind | None = None
    is_primary: bool = False
    auto_id: bool = False
    sparse_pair: bool = False

    def __post_init__(self):
        object.__setattr__(self, "kind", Kind(self.kind))
        if self.element is not None:
            object.__setattr__(self, "element", Kind(self.element))
        if self.kind in DENSE and (not self.dim or self.dim < 1):
            raise ValueError(f"{self.name}: a dense vector needs a positive dim")
        if self.kind is Kind.BINARY_VECTOR and self.dim % 8:
            raise ValueError(f"{self.name}: the dim of a binary vector is a multiple of 8")
        if Kind.VARCHAR in (self.kind, self.element) and (not self.max_length or self.max_length < 1):
            raise ValueError(f"{self.name}: VARCHAR needs a positive max_length")
        if self.kind is Kind.ARRAY and (self.element is None or self.element in DENSE | {Kind.ARRAY, Kind.JSON, Kind.SPARSE_FLOAT_VECTOR}):
            raise ValueError(f"{self.name}: an array needs a scalar element type")

    def spark_type(self) -> T.DataType:
        if self.kind is Kind.ARRAY:
            return T.ArrayType(_SPARK[self.element])
        if self.kind is Kind.SPARSE_FLOAT_VECTOR and self.sparse_pair:
            return SPARSE_PAIR
        return _SPARK[self.kind]

    def to_struct_field(self) -> T.StructField:
        own = {k: (v.value if isinstance(v, Kind) else v) for k, v in vars(self).items() if k != "name" and v not in (None, False)}
        return T.StructField(self.name, self.spark_type(), True, {_KEY: own})

    @classmethod
    def from_struct_field(cls, f: T.StructField) -> Field:
        if _KEY in f.metadata:
            return cls(f.name, **f.metadata[_KEY])
        for kind, t in _SPARK.items():
            if t == f.dataType and kind not in DENSE and kind not in (Kind.VARCHAR, Kind.JSON):
                return cls(f.name, kind)
        if isinstance(f.dataType, T.ArrayType):
            inner = cls.from_struct_field(T.StructField("element", f.dataType.elementType))
            return cls(f.name, Kind.ARRAY, element=inner.kind)
        raise ValueError(f"{f.name}: {f.dataType.simpleString()} is not supported")


@dataclass(frozen=True)
class Schema:
    """The fields of a dataset, shared by all its splits of rows."""

    fields: tuple[Field, ...]
    description: str = field(default="", compare=False)

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        names = [f.name for f in self.fields]
        if len(names) != len(set(names)):
            raise ValueError("field names must differ")
        if sum(f.is_primary for f in self.fields) > 1:
            raise ValueError("at most one field is the primary key")

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def primary(self) -> Field | None:
        return next((f for f in self.fields if f.is_primary), None)

    def struct(self) -> T.StructType:
        return T.StructType([f.to_struct_field() for f in self.fields])

    def json(self) -> str:
        return json.dumps({"description": self.description, "struct": json.loads(self.struct().json())}, indent=1)

    @classmethod
    def from_struct(cls, struct: T.StructType, description: str = "") -> Schema:
        return cls(tuple(map(Field.from_struct_field, struct)), description)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        got = json.loads(text)
        return cls.from_struct(T.StructType.fromJson(got["struct"]), got["description"])
