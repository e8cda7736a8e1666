"""Engine: named tables and every operation on them. The *_df methods stay lazy; the others run a job."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from basalt import types as bt
from basalt.errors import EngineError
from basalt.operators import relational as R
from basalt.operators.predicates import Predicate
from basalt.plans import minisql, render
from basalt.sources import catalog
from basalt.sources.managed import ManagedTable


class Engine:
    """Not safe for use from several threads. Closing forgets the tables; the session stays the caller's."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self._tables: dict[str, object] | None = {}

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._tables = None

    def _open(self) -> dict:
        if self._tables is None:
            raise EngineError("engine is closed")
        return self._tables

    # -- tables ----------------------------------------------------------------

    def create_table(self, name: str, columns: int | Sequence) -> None:
        """columns: column types, or how many UINT32 columns."""
        kinds = [bt.ColType.UINT32] * columns if isinstance(columns, int) else [bt.as_col_type(k) for k in columns]
        self._open()[name] = ManagedTable.create(self.spark, name, kinds)

    def open_table(self, name: str, col_types: Sequence | None = None) -> None:
        table = self.table(name)
        if col_types is not None and getattr(table, "kinds", None) != [bt.as_col_type(k) for k in col_types]:
            raise ValueError("column types differ from the table's")

    def table(self, name: str):
        tables = self._open()
        if name not in tables:
            tables[name] = catalog.find(self.spark, name)
        return tables[name]

    def view(self, name: str) -> DataFrame:
        return self.table(name).view()

    def _managed(self, name: str) -> ManagedTable:
        table = self.table(name)
        if not table.managed:
            raise EngineError("table is read-only")
        return table

    def num_columns(self, name: str) -> int:
        return len(R.table_schema(self.view(name)))

    def col_type(self, name: str, col: int):
        f = R.table_schema(self.view(name))[col]
        return bt.declared(f) or f.dataType

    def rows_recorded(self, name: str) -> int:
        return self.table(name).rows_recorded()

    def live_rows(self, name: str) -> int:
        return self.view(name).count()

    def is_live(self, name: str, rid: int) -> bool:
        return bool(R.fetch(self.view(name), rid).head(1))

    # -- rows --------------------------------------------------------------------

    def insert(self, name: str, values: Sequence) -> int:
        return self._managed(name).insert(values)

    def insert_many(self, name: str, rows: DataFrame | Iterable[Sequence]) -> int:
        return self._managed(name).insert_many(rows)

    def delete(self, name: str, rid: int) -> None:
        self._managed(name).delete(rid)

    def delete_many(self, name: str, rids: DataFrame) -> None:
        self._managed(name).delete_many(rids)

    def flush(self, name: str) -> None:
        self._managed(name).flush()

    def fetch_row(self, name: str, rid: int, num_cols: int | None = None) -> list:
        """The first num_cols values of a live row (all of them by default)."""
        view = self.view(name)
        width = len(R.table_schema(view))
        if num_cols is not None and not 0 < num_cols <= width:
            raise ValueError("column index out of bounds")
        got = R.project(view.filter(view[R.ROW_ID] == rid), range(num_cols or width)).head(1)
        if not got:
            raise EngineError(f"row not found: {rid}")
        return list(got[0])

    def project_rows(self, name: str, rids: Sequence[int], cols: Sequence[int]) -> list[list]:
        """Rows in the order of rids; dead and unknown IDs are left out."""
        ids = self.spark.createDataFrame([(int(r), i) for i, r in enumerate(rids)], f"{R.ROW_ID} bigint, _pos bigint")
        return [list(r)[:-1] for r in R.project_rows(self.view(name), ids, cols).orderBy("_pos").collect()]

    # -- scans -------------------------------------------------------------------

    def scan_eq_df(self, name: str, col: int, value: int) -> DataFrame:
        return R.where_eq(self.view(name), col, value)

    def scan_between_df(self, name: str, col: int, lo: int, hi: int) -> DataFrame:
        return R.where_between(self.view(name), col, lo, hi)

    def scan_eq_string_df(self, name: str, col: int, needle: str) -> DataFrame:
        return R.where_eq_string(self.view(name), col, needle)

    def where_and_df(self, name: str, preds: Sequence[Predicate]) -> DataFrame:
        return R.where_and(self.view(name), preds)

    def where_or_df(self, name: str, preds: Sequence[Predicate]) -> DataFrame:
        return R.where_or(self.view(name), preds)

    @staticmethod
    def _ids(df: DataFrame) -> list[int]:
        return [r[0] for r in df.orderBy(R.ROW_ID).collect()]

    def scan_eq(self, name: str, col: int, value: int) -> list[int]:
        return self._ids(self.scan_eq_df(name, col, value))

    def scan_between(self, name: str, col: int, lo: int, hi: int) -> list[int]:
        return self._ids(self.scan_between_df(name, col, lo, hi))

    def scan_eq_string(self, name: str, col: int, needle: str) -> list[int]:
        return self._ids(self.scan_eq_string_df(name, col, needle))

    def where_and(self, name: str, preds: Sequence[Predicate]) -> list[int]:
        return self._ids(self.where_and_df(name, preds))

    def where_or(self, name: str, preds: Sequence[Predicate]) -> list[int]:
        return self._ids(self.where_or_df(name, preds))

    # -- aggregates ----------------------------------------------------------------

    def sum(self, name: str, col: int, wrap_u32: bool = False):
        return R.sum_column(self.view(name), col, wrap_u32).head()[0]

    def extreme_df(self, name: str, fn: str, col: int) -> DataFrame:
        """min or max of a column, from file footers where the table is an outside file and they hold it exactly."""
        table = self.table(name)
        if not table.managed and table.in_footers(col):
            return table.extreme(fn, col)
        return {"min": R.min_column, "max": R.max_column}[fn](self.view(name), col)

    def _extreme(self, name: str, fn: str, col: int):
        try:
            return self.extreme_df(name, fn, col).head()[0]
        except Py4JJavaError:  # a file without statistics
            return {"min": R.min_column, "max": R.max_column}[fn](self.view(name), col).head()[0]

    def min(self, name: str, col: int):
        return self._extreme(name, "min", col)

    def max(self, name: str, col: int):
        return self._extreme(name, "max", col)

    def group_df(self, name: str, fn: str, key: int, value: int | None = None) -> DataFrame:
        return R.group_aggregate(self.view(name), fn, key, value)

    def _grouped(self, *args) -> dict:
        return {r[0]: r[1] for r in self.group_df(*args).collect()}

    def group_count(self, name: str, key: int) -> dict:
        return self._grouped(name, "count", key)

    def group_sum(self, name: str, key: int, value: int) -> dict:
        return self._grouped(name, "sum", key, value)

    def group_avg(self, name: str, key: int, value: int) -> dict:
        return self._grouped(name, "avg", key, value)

    def group_min(self, name: str, key: int, value: int) -> dict:
        return self._grouped(name, "min", key, value)

    def group_max(self, name: str, key: int, value: int) -> dict:
        return self._grouped(name, "max", key, value)

    def join_df(self, left: str, left_col: int, right: str, right_col: int) -> DataFrame:
        return R.join_row_ids(self.view(left), left_col, self.view(right), right_col)

    def join(self, left: str, left_col: int, right: str, right_col: int) -> list[tuple[int, int]]:
        return [tuple(r) for r in self.join_df(left, left_col, right, right_col).orderBy("left_rid", "right_rid").collect()]

    # -- SQL -------------------------------------------------------------------------

    def sql_df(self, sql: str) -> DataFrame:
        q = minisql.parse(sql)
        return minisql.build(q, self.view(q.table))

    def sql_lines(self, sql: str) -> Iterable[str]:
        """Header and rows as lines of tab-separated text, fetched as they are read. Wrong statements fail at once."""
        q = minisql.parse(sql)
        return render.lines(q, minisql.build(q, self.view(q.table), ordered=True))

    def sql_text(self, sql: str) -> str:
        """All of sql_lines() as one string."""
        return "".join(self.sql_lines(sql))

    def sql_to_files(self, sql: str, folder: str) -> None:
        """The result as tab-separated files with headers, written by the tasks: no row passes the driver, rows have no
        order, and numbers are written in full. The folder must not exist."""
        self.sql_df(sql).write.option("sep", "\t").option("header", True).csv(folder)
