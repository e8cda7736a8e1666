"""What the operators share: stored intermediate tables, texts as bytes, and checks of their inputs."""
from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and \t \n \v \f \r. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a temporary one if all of Spark runs in one
    process, as in tests; on a cluster that is refused, as executors would write to folders of their own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="basalt-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


@contextlib.contextmanager
def configured(spark: SparkSession, **values: str):
    """Session settings for as long as a step runs."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later steps that lose an executor
    read it again instead of computing it again. Its shuffle files go when it is written; else Spark keeps them until
    the driver happens to collect its garbage."""
    path = f"{shared_dir(df.sparkSession)}/basalt-{name}-{uuid.uuid4().hex}"
    with configured(df.sparkSession, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._basalt_path = path
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(df._basalt_path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def picked(df: DataFrame, keys: DataFrame, key: str, name: str, fn=lambda joined: joined) -> DataFrame:
    """fn of the join of df with keys on key, stored. While keys are few, Spark makes a Bloom filter of them (of
    bounded size) that keeps df's other rows out of the exchange; it does so where keys are filtered."""
    few = stored(keys.withColumn("_picked", F.lit(1)), f"{name}-keys")
    bloom = "spark.sql.optimizer.runtime.bloomFilter"
    with configured(df.sparkSession, **{f"{bloom}.enabled": "true", f"{bloom}.applicationSideScanSizeThreshold": "0"}):
        return stored(fn(df.join(few.where("_picked > 0").drop("_picked"), key)), name)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the columns named in more; nothing else is read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def ids_and_bytes(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(doc_id, text as UTF-8) of each row, without making str objects."""
    col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    yield from zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), (b or b"" for b in col.to_pylist()), strict=True)


def text_batches(spark: SparkSession, size: int = 1 << 20):
    """Arrow batches bounded in bytes for as long as a step runs: texts can be long, and a worker holds a batch at a time."""
    return configured(spark, **{"spark.sql.execution.arrow.maxBytesPerBatch": f"{size}b"})


def give_back() -> None:
    """Returns what this process has freed to the system; the allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run):
    """run, a function of batches, that gives memory back as a task ends: an executor has more workers than tasks, which take turns,
    and one that waits would hold as much as its largest task did."""

    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number's bits spread over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def batch_of(**columns) -> pa.RecordBatch:
    """An Arrow batch of numpy arrays or Arrow arrays."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def crc_mod(doc_id, n: int):
    """crc32 of doc_id as text, modulo n: the folds of labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
