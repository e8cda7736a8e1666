"""Read-only tables over outside Parquet files: `<base>.parquet`, a file or a folder of files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators.relational import ROW_ID, table_schema
from basalt.sources.fs import Store


class ParquetTable:
    """Row IDs are file positions. Several files are numbered one after another by path, so the IDs stay
    dense; the offsets come from one count a file, and are joined to the rows by path."""

    managed = False

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._view: DataFrame | None = None
        self._footers: DataFrame | None = None

    def view(self) -> DataFrame:
        if self._view is None:
            df = self.spark.read.parquet(self.path)
            if not Store(self.spark).is_dir(self.path):
                self._view = df.withColumn(ROW_ID, F.col("_metadata.row_index"))
            else:
                counts = sorted(df.groupBy(F.col("_metadata.file_path").alias("f")).count().collect())
                offsets, at = [], 0
                for f, n in counts:
                    offsets.append((f, at))
                    at += n
                names = df.columns
                at_file = self.spark.createDataFrame(offsets, "_f string, _o bigint")
                df = df.select("*", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.row_index").alias("_i"))
                self._view = df.join(at_file, F.col("_p") == F.col("_f")).select(*(F.col(f"`{c}`") for c in names), (F.col("_i") + F.col("_o")).alias(ROW_ID))
        return self._view

    def in_footers(self, col: int) -> bool:
        """Whether statistics hold this column's extremes exactly: integers only. Those of floating numbers leave NaN out."""
        fields = table_schema(self.view()).fields
        return isinstance(col, int) and 0 <= col < len(fields) and isinstance(fields[col].dataType, T.IntegralType)

    def extreme(self, fn: str, col: int) -> DataFrame:
        """min or max of an integer column, from the footers of the files alone. Spark pushes aggregates into
        Parquet in its newer reader only, so this has a session of its own; a file without statistics fails the job."""
        name = table_schema(self.view()).names[col]
        if self._footers is None:
            aside = self.spark.newSession()
            aside.conf.set("spark.sql.sources.useV1SourceList", "")
            aside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
            self._footers = aside.read.parquet(self.path)
        return self._footers.agg({"min": F.min, "max": F.max}[fn](F.col(f"`{name}`")).alias("value"))

    def rows_recorded(self) -> int:
        return self.view().count()
