"""Column types, their Spark counterparts and value checks.

Spark has no unsigned integers, so UINT32 is a LongType whose field metadata
carries the tag and whose values are range-checked on the way in.
"""
from __future__ import annotations

import enum
import math
import numbers
import struct

from pyspark.sql import types as T

UINT32_MAX = 0xFFFFFFFF
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1
TAG = "coltype"


class ColType(enum.Enum):
    UINT32 = "UINT32"
    INT64 = "INT64"
    FLOAT = "FLOAT"
    DOUBLE = "DOUBLE"
    STRING = "STRING"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def numeric(self) -> bool:
        return self is not ColType.STRING


_SPARK = {
    ColType.UINT32: T.LongType(),
    ColType.INT64: T.LongType(),
    ColType.FLOAT: T.FloatType(),
    ColType.DOUBLE: T.DoubleType(),
    ColType.STRING: T.StringType(),
}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_col_type(kind) -> ColType:
    if isinstance(kind, ColType):
        return kind
    try:
        return ColType[str(kind).upper()]
    except KeyError:
        raise ValueError(f"unknown column type: {kind!r}") from None


def field(index: int, kind: ColType) -> T.StructField:
    return T.StructField(f"c{index}", kind.spark, True, {TAG: kind.value})


def declared(f: T.StructField) -> ColType | None:
    """The type a managed table declared for this column; None for a column of an outside file."""
    tag = (f.metadata or {}).get(TAG)
    return ColType(tag) if tag else None


def unsigned_like(f: T.StructField) -> bool:
    """Whether numeric predicates and grouped aggregates accept the column.

    Declared columns must be UINT32; columns of outside files may be any integer type.
    """
    kind = declared(f)
    return kind is ColType.UINT32 if kind else isinstance(f.dataType, _INTEGRAL)


def numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def stringy(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def check_u32(value) -> int:
    if isinstance(value, bool) or not isinstance(value, numbers.Integral):
        raise ValueError(f"expected an integer, got {value!r}")
    if not 0 <= value <= UINT32_MAX:
        raise ValueError(f"value out of UINT32 range: {value}")
    return int(value)


def check_value(kind: ColType, value):
    """The value as stored, or ValueError. NULL is not a value in declared tables."""
    if kind is ColType.UINT32:
        return check_u32(value)
    if kind is ColType.INT64:
        if isinstance(value, bool) or not isinstance(value, numbers.Integral):
            raise ValueError(f"expected an integer, got {value!r}")
        if not INT64_MIN <= value <= INT64_MAX:
            raise ValueError(f"value out of INT64 range: {value}")
        return int(value)
    if kind is ColType.STRING:
        if not isinstance(value, str):
            raise ValueError(f"expected a string, got {value!r}")
        return value
    if isinstance(value, bool) or not isinstance(value, numbers.Real):
        raise ValueError(f"expected a number, got {value!r}")
    if kind is ColType.FLOAT and math.isfinite(value):
        return struct.unpack("<f", struct.pack("<f", value))[0]
    return float(value)
