"""Scans, projection, row-ID sets, aggregates and joins over a live view.

A live view is a DataFrame whose first columns are the table's own, in order,
followed by the hidden row ID in ROW_ID.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import types as bt
from basalt.functions.scalar import wrap_u32
from basalt.operators import predicates as P

ROW_ID = "_rid"


def table_schema(view: DataFrame) -> T.StructType:
    return T.StructType([f for f in view.schema.fields if f.name != ROW_ID])


def column(view: DataFrame, index: int) -> Column:
    fields = table_schema(view).fields
    if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index < len(fields):
        raise ValueError("column index out of bounds")
    return F.col(f"`{fields[index].name}`")


def _field(view: DataFrame, index: int) -> T.StructField:
    column(view, index)
    return table_schema(view)[index]


def all_columns(view: DataFrame) -> DataFrame:
    return view.drop(ROW_ID)


def row_ids(view: DataFrame) -> DataFrame:
    return view.select(ROW_ID)


def column_scan(view: DataFrame, index: int, with_row_id: bool = False) -> DataFrame:
    return view.select(*([ROW_ID] if with_row_id else []), column(view, index))


def fetch(view: DataFrame, rid: int) -> DataFrame:
    return all_columns(view.filter(F.col(ROW_ID) == F.lit(rid)))


def project(view: DataFrame, indexes: Sequence[int]) -> DataFrame:
    return view.select(*(column(view, i) for i in indexes))


def project_rows(view: DataFrame, rids: DataFrame, indexes: Sequence[int]) -> DataFrame:
    """Columns of the live rows among rids (one column ROW_ID), a repeated ID giving a repeated row.

    rids keeps its other columns, so a caller that wants its own order carries a position in it.
    No hint: Spark broadcasts rids only if its size estimate is under the threshold.
    """
    extra = [c for c in rids.columns if c != ROW_ID]
    return rids.join(view, ROW_ID).select(*(column(view, i) for i in indexes), *extra)


def where_eq(view: DataFrame, index: int, value: int) -> DataFrame:
    if not bt.unsigned_like(_field(view, index)):
        raise ValueError("numeric predicates require UINT32 columns")
    return row_ids(view.filter(column(view, index) == F.lit(bt.check_u32(value))))


def where_between(view: DataFrame, index: int, lo: int, hi: int) -> DataFrame:
    """Inclusive range; lo above hi is an empty range here, unlike in a Predicate."""
    if not bt.unsigned_like(_field(view, index)):
        raise ValueError("numeric predicates require UINT32 columns")
    return row_ids(view.filter(column(view, index).between(bt.check_u32(lo), bt.check_u32(hi))))


def where_eq_string(view: DataFrame, index: int, needle: str) -> DataFrame:
    return where_and(view, [P.Predicate.eq_string(index, needle)])


def where_and(view: DataFrame, preds: Sequence[P.Predicate]) -> DataFrame:
    return row_ids(view.filter(P.conjunction(preds, table_schema(view))))


def where_or(view: DataFrame, preds: Sequence[P.Predicate]) -> DataFrame:
    return row_ids(view.filter(P.disjunction(preds, table_schema(view))))


def intersect_row_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row IDs are unique within a set, so a semi join intersects without a distinct."""
    return a.join(b, ROW_ID, "left_semi")


def union_row_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def sum_column(view: DataFrame, index: int, wrap: bool = False) -> DataFrame:
    """Exact sum, 0 over no rows; wrap gives it modulo 2^32 as a 32-bit accumulator would."""
    f = _field(view, index)
    if not bt.numeric(f):
        raise ValueError("aggregate functions require numeric columns")
    total = F.coalesce(F.sum(column(view, index)), F.lit(0))
    return view.agg((wrap_u32(total) if wrap else total).alias("value"))


def _extreme(view: DataFrame, index: int, fn, empty: int) -> DataFrame:
    f = _field(view, index)
    if not bt.numeric(f):
        raise ValueError("aggregate functions require numeric columns")
    got = fn(column(view, index))
    return view.agg((F.coalesce(got, F.lit(empty)) if bt.declared(f) is bt.ColType.UINT32 else got).alias("value"))


def min_column(view: DataFrame, index: int) -> DataFrame:
    """Smallest value; a declared UINT32 column without rows gives 2^32-1, others NULL."""
    return _extreme(view, index, F.min, bt.UINT32_MAX)


def max_column(view: DataFrame, index: int) -> DataFrame:
    """Largest value; a declared UINT32 column without rows gives 0, others NULL."""
    return _extreme(view, index, F.max, 0)


#: SQL-style scalar aggregates: 0 for COUNT, SUM and AVG over no rows, NULL for MIN and MAX.
AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "min": F.min,
    "max": F.max,
    "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
}


def scalar_aggregates(view: DataFrame, wanted: Sequence[tuple[str, int | None, str]]) -> DataFrame:
    """One row; wanted holds (function, column index or None, name) for each value, all from one scan."""
    for name, index, _ in wanted:
        if name != "count" and not bt.numeric(_field(view, index)):
            raise ValueError("aggregate functions require numeric columns")
    return view.agg(*(AGGREGATES[name](None if name == "count" else column(view, index)).alias(alias) for name, index, alias in wanted))


def scalar_aggregate(view: DataFrame, name: str, index: int | None, alias: str = "value") -> DataFrame:
    return scalar_aggregates(view, [(name, index, alias)])


def group_aggregate(view: DataFrame, name: str, key: int, value: int | None = None, names=("key", "value")) -> DataFrame:
    """One aggregate per key. Partial aggregation runs before the exchange, so a hot key costs a row a task."""
    fn = {**AGGREGATES, "sum": F.sum, "avg": F.avg}[name]
    arg = None if name == "count" else column(view, value)
    if name != "count" and not bt.numeric(_field(view, value)):
        raise ValueError("aggregate functions require numeric columns")
    return view.groupBy(column(view, key).alias(names[0])).agg(fn(arg).alias(names[1]))


def join_row_ids(left: DataFrame, left_col: int, right: DataFrame, right_col: int) -> DataFrame:
    """Inner equi join as (left_rid, right_rid). Only key and row ID of either side reach the exchange;
    Spark picks broadcast by its size threshold, and splits a hot key as a skewed join otherwise."""
    lk, rk = _field(left, left_col).dataType, _field(right, right_col).dataType
    if isinstance(lk, T.StringType) != isinstance(rk, T.StringType):
        raise ValueError("join columns must both be strings or both be numeric")
    a = left.select(column(left, left_col).alias("lk"), F.col(ROW_ID).alias("left_rid"))
    b = right.select(column(right, right_col).alias("rk"), F.col(ROW_ID).alias("right_rid"))
    return a.join(b, F.col("lk") == F.col("rk")).select("left_rid", "right_rid")
