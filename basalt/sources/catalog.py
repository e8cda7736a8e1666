"""Finds the table behind a base path: a managed one, or an outside Parquet file."""
from __future__ import annotations

from pyspark.sql import SparkSession

from basalt.errors import EngineError
from basalt.sources.fs import Store
from basalt.sources.managed import ManagedTable
from basalt.sources.parquet import ParquetTable


def find(spark: SparkSession, name: str) -> ManagedTable | ParquetTable:
    """Opens name without ever creating a file; recovery of a managed table runs here."""
    store = Store(spark)
    if store.exists(ManagedTable.root_of(name)):
        return ManagedTable(spark, ManagedTable.root_of(name))
    if store.exists(f"{name}.parquet"):
        return ParquetTable(spark, f"{name}.parquet")
    raise EngineError("table does not exist")
