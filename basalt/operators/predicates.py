"""Predicates on positional columns: equality, inclusive range, string equality."""
from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import types as bt


@dataclass(frozen=True)
class Predicate:
    """One test of one column. Build it with eq(), between() or eq_string()."""

    col: int
    kind: str
    lo: int = 0
    hi: int = 0
    needle: str = ""

    def __post_init__(self):
        if isinstance(self.col, bool) or not isinstance(self.col, int) or not 0 <= self.col <= 0xFFFF:
            raise ValueError(f"column index out of range: {self.col!r}")

    @classmethod
    def eq(cls, col: int, value: int) -> Predicate:
        v = bt.check_u32(value)
        return cls(col, "eq", v, v)

    @classmethod
    def between(cls, col: int, lo: int, hi: int) -> Predicate:
        return cls(col, "between", bt.check_u32(lo), bt.check_u32(hi))

    @classmethod
    def eq_string(cls, col: int, needle: str) -> Predicate:
        if not isinstance(needle, str):
            raise ValueError(f"needle must be a string, got {needle!r}")
        return cls(col, "eq_string", needle=needle)

    def validate(self, schema: T.StructType) -> None:
        if self.col >= len(schema):
            raise ValueError("predicate column index out of bounds")
        f = schema[self.col]
        if self.kind == "eq_string":
            if not bt.stringy(f):
                raise ValueError("string predicates require STRING columns")
            return
        if not bt.unsigned_like(f):
            raise ValueError("numeric predicates require UINT32 columns")
        if self.lo > self.hi:
            raise ValueError("BETWEEN predicates require lo <= hi")

    def to_column(self, schema: T.StructType) -> Column:
        c = F.col(f"`{schema[self.col].name}`")
        if self.kind == "eq_string":
            return c == F.lit(self.needle)
        return c == F.lit(self.lo) if self.kind == "eq" else c.between(self.lo, self.hi)


def _checked(preds: Sequence[Predicate], schema: T.StructType) -> list[Column]:
    """Every predicate is validated before any becomes part of a plan."""
    for p in preds:
        if not isinstance(p, Predicate):
            raise ValueError(f"expected a Predicate, got {p!r}")
        p.validate(schema)
    return [p.to_column(schema) for p in preds]


def conjunction(preds: Sequence[Predicate], schema: T.StructType) -> Column:
    """All of preds; no predicates at all keep every row."""
    return reduce(operator.and_, _checked(preds, schema), F.lit(True))


def disjunction(preds: Sequence[Predicate], schema: T.StructType) -> Column:
    """Any of preds; no predicates at all keep no row."""
    return reduce(operator.or_, _checked(preds, schema), F.lit(False))
