"""Managed tables: a columnar base, an operation log beside it, and checkpoints that fold one into the other.

    <name>.tbl/MANIFEST            {"version", "next_rid", "types"}
    <name>.tbl/base/v=N/*.parquet  c0..ck and _rid: all rows live at checkpoint N
    <name>.tbl/log/v=N/<seq>.op    one operation and its checksum
    <name>.tbl/log/v=N/<seq>.ok    commit marker; an operation counts from then on
    <name>.tbl/log/v=N/<seq>.rows  Parquet rows (or row IDs) of a batch operation

After LOG_LIMIT operations the log is folded into the next base by itself, which bounds what recovery
reads and what a table keeps in driver memory. The files of the checkpoint before stay until the next
one, for DataFrames taken before it. The live view is base plus committed inserts, less committed deletes. Recovery reads the log in
order and stops at the first operation that is unmarked or damaged. Row IDs are append ordinals:
dense, from 0, never given twice; next_rid is stored because live rows alone don't tell it.
"""
from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import types as bt
from basalt.errors import EngineError
from basalt.functions.ordinal import dense_ordinals
from basalt.operators.relational import ROW_ID
from basalt.sources.fs import Store


#: Operations in the log before an automatic checkpoint.
LOG_LIMIT = 1000


def _seal(op: dict) -> str:
    body = json.dumps(op, sort_keys=True)
    return json.dumps({"crc": zlib.crc32(body.encode()), "op": body})


def _unseal(text: str) -> dict | None:
    """The operation, or None if its text is torn or fails its checksum."""
    try:
        sealed = json.loads(text)
        return json.loads(sealed["op"]) if zlib.crc32(sealed["op"].encode()) == sealed["crc"] else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


class ManagedTable:
    managed = True

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root, Store(spark)
        self._load()

    @staticmethod
    def root_of(name: str) -> str:
        return f"{name}.tbl"

    @classmethod
    def create(cls, spark: SparkSession, name: str, kinds: Sequence[bt.ColType]) -> ManagedTable:
        """A new, empty table; whatever was at the path before is gone."""
        if not kinds or len(kinds) > 0xFFFF:
            raise ValueError("a table needs 1 to 65535 columns")
        root, store = cls.root_of(name), Store(spark)
        store.delete(root)
        store.mkdirs(f"{root}/log/v=0")
        store.write(f"{root}/MANIFEST", json.dumps({"version": 0, "next_rid": 0, "types": [k.value for k in kinds]}))
        return cls(spark, root)

    # -- state ---------------------------------------------------------------

    def _load(self) -> None:
        at = f"{self.root}/MANIFEST"
        if not self.store.exists(at):  # a checkpoint may have died between deleting and renaming
            at = f"{at}.tmp"
        manifest = json.loads(self.store.read(at))
        self.version, self.next_rid = manifest["version"], manifest["next_rid"]
        self.kinds = [bt.ColType(k) for k in manifest["types"]]
        self.schema = T.StructType([bt.field(i, k) for i, k in enumerate(self.kinds)])
        self.full = T.StructType([*self.schema.fields, T.StructField(ROW_ID, T.LongType(), True)])
        self._inserts: dict[int, tuple] = {}
        self._batches: list[str] = []
        self._dead: set[int] = set()
        self._dead_batches: list[str] = []
        self._seq = 0
        self._view: DataFrame | None = None
        self.recovered = self._replay()

    @property
    def _log(self) -> str:
        return f"{self.root}/log/v={self.version}"

    def _replay(self) -> int:
        names, done = set(self.store.names(self._log)), 0
        while f"{self._seq:012d}.op" in names:
            stem = f"{self._seq:012d}"
            op = _unseal(self.store.read(f"{self._log}/{stem}.op")) if f"{stem}.ok" in names else None
            if op is None:
                break
            self._apply(op)
            self._seq += 1
            done += 1
        for name in names:  # what follows the first bad operation never happened
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) >= self._seq:
                self.store.delete(f"{self._log}/{name}")
        return done

    def _apply(self, op: dict) -> None:
        if op["kind"] in ("insert", "insert_rows"):
            if op["rid"] > self.next_rid:
                raise EngineError(f"row ID gap in the log: expected {self.next_rid}, found {op['rid']}")
            if op["rid"] < self.next_rid:
                return  # applied before
            if op["kind"] == "insert":
                self._inserts[op["rid"]] = tuple(op["values"])
                self.next_rid += 1
            else:
                self._batches.append(f"{self._log}/{op['rows']}")
                self.next_rid += op["count"]
        elif op["kind"] == "delete":
            self._dead.add(op["rid"])
        else:
            self._dead_batches.append(f"{self._log}/{op['rows']}")
        self._view = None

    def _commit(self, op: dict) -> None:
        stem = f"{self._log}/{self._seq:012d}"
        self.store.write(f"{stem}.op", _seal(op))
        self.store.write(f"{stem}.ok", "")
        self._seq += 1
        self._apply(op)
        if self._seq >= LOG_LIMIT:
            self.flush()

    # -- rows ----------------------------------------------------------------

    def check_row(self, values: Sequence) -> list:
        if len(values) != len(self.kinds):
            raise ValueError(f"expected {len(self.kinds)} values, got {len(values)}")
        return [bt.check_value(k, v) for k, v in zip(self.kinds, values, strict=True)]

    def insert(self, values: Sequence) -> int:
        rid = self.next_rid
        self._commit({"kind": "insert", "rid": rid, "values": self.check_row(values)})
        return rid

    def insert_many(self, rows: DataFrame | Iterable[Sequence]) -> int:
        """Appends rows as one operation and returns the first row ID. The rows of a DataFrame are numbered
        partition by partition and never pass the driver; values outside a column's type fail the write."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([tuple(self.check_row(r)) for r in rows], self.schema)
        if len(rows.columns) != len(self.kinds):
            raise ValueError(f"expected {len(self.kinds)} columns, got {len(rows.columns)}")
        columns = []
        for f, name, kind in zip(self.schema.fields, rows.columns, self.kinds, strict=True):
            c = F.col(f"`{name}`").cast(f.dataType)
            bad = c.isNull() | (~c.between(0, bt.UINT32_MAX) if kind is bt.ColType.UINT32 else F.lit(False))
            columns.append(F.when(bad, F.raise_error(F.lit(f"column {f.name}: value outside {kind.value}"))).otherwise(c).cast(f.dataType).alias(f.name))
        aside, rows_at = f"{self._log}/staged-{uuid.uuid4().hex}", f"{self._seq:012d}.rows"
        rows.select(*columns).withColumn("_mid", F.monotonically_increasing_id()).write.parquet(aside)
        staged = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_mid", T.LongType())])).parquet(aside)
        first, count = self.next_rid, staged.count()
        dense_ordinals(staged, "_mid", ROW_ID, first).select(*self.full.names).write.mode("overwrite").parquet(f"{self._log}/{rows_at}")
        self.store.delete(aside)
        self._commit({"kind": "insert_rows", "rid": first, "count": count, "rows": rows_at})
        return first

    def delete(self, rid: int) -> None:
        """Deleting an unknown or dead row does nothing."""
        if 0 <= rid < self.next_rid and rid not in self._dead:
            self._commit({"kind": "delete", "rid": int(rid)})

    def delete_many(self, rids: DataFrame) -> None:
        """Deletes every row ID in rids (one column) as one operation."""
        rows_at = f"{self._seq:012d}.rows"
        rids.select(F.col(rids.columns[0]).cast("bigint").alias(ROW_ID)).distinct().write.mode("overwrite").parquet(f"{self._log}/{rows_at}")
        self._commit({"kind": "delete_rows", "rows": rows_at})

    def view(self) -> DataFrame:
        if self._view is None:
            read = self.spark.read.schema(self.full)
            parts = [read.parquet(f"{self.root}/base/v={self.version}")] if self.store.exists(f"{self.root}/base/v={self.version}") else []
            if self._batches:
                parts.append(read.parquet(*self._batches))
            if self._inserts or not parts:
                parts.append(self.spark.createDataFrame([(*v, rid) for rid, v in self._inserts.items()], self.full))
            view = parts[0]
            for p in parts[1:]:
                view = view.union(p)
            if self._dead:
                dead = self.spark.createDataFrame([(r,) for r in sorted(self._dead)], f"{ROW_ID} bigint")
                view = view.join(dead, ROW_ID, "left_anti")
            if self._dead_batches:
                view = view.join(self.spark.read.parquet(*self._dead_batches), ROW_ID, "left_anti")
            # Unions lose field metadata; the declared types are put back.
            self._view = view.select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in self.schema.fields), ROW_ID)
        return self._view

    def rows_recorded(self) -> int:
        return self.next_rid

    def flush(self) -> None:
        """Checkpoint: writes all live rows as the next base, switches the manifest, drops the old log."""
        if not self._seq:
            return
        old, new = self.version, self.version + 1
        self.view().write.mode("overwrite").parquet(f"{self.root}/base/v={new}")
        self.store.delete(f"{self.root}/log/v={new}")
        self.store.mkdirs(f"{self.root}/log/v={new}")
        self.store.write(f"{self.root}/MANIFEST", json.dumps({"version": new, "next_rid": self.next_rid, "types": [k.value for k in self.kinds]}), replace=True)
        self._load()
        for part in ("log", "base"):
            self.store.delete(f"{self.root}/{part}/v={old - 1}")
