"""Text of results: tab-separated, integers exact, floating numbers with six significant digits."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from basalt.plans.minisql import Query


def cell(value) -> str:
    if value is None:
        return ""
    return "%g" % value if isinstance(value, float) else str(value)


def rows_of(query: Query, df: DataFrame) -> Iterable[list[str]]:
    """Rows as strings, fetched a partition at a time. Scalar SUM prints like a floating number even
    over integers; grouped SUM prints exactly."""
    loose = not query.key and query.items[0].fn == "sum"
    for row in df.toLocalIterator():
        yield [cell(float(v)) if loose and v is not None else cell(v) for v in row]


def lines(query: Query, df: DataFrame) -> Iterable[str]:
    """Header and rows, each with its line end, as they are fetched: one partition is in driver memory at a time."""
    yield "\t".join(df.columns) + "\n"
    for r in rows_of(query, df):
        yield "\t".join(r) + "\n"
