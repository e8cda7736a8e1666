"""Exact dedup: stateful streaming deduplication with disk-backed keyed state.

Texts are equal when identical after each run of white space becomes one space. A stream of the
documents' files feeds keyed state in RocksDB, without expiry: for each SHA-256 digest the smallest
doc_id so far (the stable identifier), where its text is (file and row: the content locator) and how
many rows came. Spark combines a digest's rows before the exchange, so a hot digest costs one row a
task. Hits are then checked: each is compared with the full text of the row that stays, and should two
texts share a digest, those are grouped by text instead.

Null texts count as empty. Repeated rows (same doc_id and text) are rows of one group; the smallest
doc_id stays once. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import SPACE, configured, drop_stored, picked, shared_dir, stored

#: Bytes of input for each partition of the state, and the fewest partitions. Every RocksDB instance holds
#: 4 MB of disk however little state it has, so there is no use in as many as a shuffle has tasks.
STATE_BYTES, STATE_LEAST = 2 << 30, 8
#: The stream ignores new files older than the newest seen by more than this: beyond any backfill.
MAX_FILE_AGE = "36500d"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def fold_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, state_dir: str | None = None) -> DataFrame:
    """Runs the stream over every file under path that its state has not seen, and returns the state:
    digest, keep_id, keep_file, keep_row, group_size.

    With a state_dir of an earlier run, only new files are read and old digests are still known. Each
    micro-batch writes the digests it changed; of a digest's rows, the last batch's counts.
    """
    root = state_dir or f"{shared_dir(spark)}/basalt-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", MAX_FILE_AGE)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    partitions = max(STATE_LEAST, fs.getContentSummary(at).getLength() // STATE_BYTES)
    if not fs.getFileStatus(at).isDirectory():
        reader = reader.option("pathGlobFilter", at.getName())  # streams watch folders: the one of the file
        path = at.getParent().toString()
    rows = reader.parquet(path).select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    state = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "f", "r")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    changed = f"{root}/changed"

    def write(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.f").alias("keep_file"), F.col("keep.r").alias("keep_row"), "group_size")
        flat.write.mode("overwrite").parquet(f"{changed}/batch={batch_id}")  # again after a failure: the same folder

    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.internal.stateStore.partitions": str(partitions), "spark.sql.streaming.numRecentProgressUpdates": "1"}
    with configured(spark, **conf):
        q = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out_schema = "digest string, keep_id bigint, keep_file string, keep_row bigint, group_size bigint, batch int"
    try:
        seen = spark.read.schema(out_schema).parquet(changed)
    except Exception as e:  # no file has ever come
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], out_schema).drop("batch")
    batches = seen.select("batch").distinct().count()
    last = seen if batches == 1 else seen.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "keep_file", "keep_row", "group_size")).alias("l")).select("digest", "l.*")
    return last.drop("batch")


#: Hits that meet one copy of a kept text in a task; a larger group gets more copies of it.
HITS_PER_COPY = 256


def _verdict(docs: DataFrame, groups: DataFrame, *more: str) -> DataFrame:
    """Each row's group, by digest; no text leaves its task."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest(F.col("text")).alias("digest"), *more)
    return stored(rows.join(groups, "digest"), "verdict")


def check_hits(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """doc_id and digest of rows whose text differs from the kept text of their digest: of collisions.

    Only texts of groups of two rows and more are moved: while their IDs are few, a Bloom filter of them (its
    size is bounded) keeps the other texts out of the exchange. A group's hits are dealt over
    ceil(size / HITS_PER_COPY) parts, each with its own copy of the kept text, so no task gets a large group.
    """
    many = verdict.where("group_size > 1").select("doc_id", "digest", "keep_id", "group_size").distinct()
    rows = picked(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text")), many, "doc_id", "texts")
    parts = F.ceil(F.col("group_size") / HITS_PER_COPY).cast("int")
    hit = rows.where("doc_id <> keep_id").select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), "text")
    kept = rows.where("doc_id = keep_id").dropDuplicates(["digest"]).select("digest", F.col("text").alias("kept"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    odd = stored(hit.join(kept, ["digest", "part"]).where("text <> kept").select("doc_id", "digest"), "collisions")
    drop_stored(rows)
    return odd


def deduplicate(spark: SparkSession, path: str) -> DataFrame:
    """One row per document under path: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = spark.read.parquet(path)
    verdict = _verdict(docs, fold_stream(spark, path).select("digest", "keep_id", "group_size"))
    collided, out = check_hits(docs, verdict), verdict
    if collided.head(1):  # two texts share a digest: group the texts of those digests themselves
        odd = collided.select("digest").distinct()
        by_text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("n")).withColumn("digest", _digest(F.col("n"))).join(odd, "digest", "left_semi")
        exact = by_text.groupBy("digest", "n").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        redone = by_text.join(exact, ["digest", "n"]).select("digest", "doc_id", "keep_id", "group_size")
        out = verdict.join(odd, "digest", "left_anti").select("digest", "doc_id", "keep_id", "group_size").unionByName(redone)
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. docs is written to the shared folder first, as the
    stream reads files; the rows that stay are found there by their locators, so of rows that repeat a
    doc_id one stays too. A row that only shares a digest with another text stays."""
    rows = stored(docs, "docs")
    groups = fold_stream(docs.sparkSession, rows._basalt_path).select("digest", "keep_id", "keep_file", "keep_row", "group_size")
    placed = docs.sparkSession.read.schema(docs.schema).parquet(rows._basalt_path).select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    verdict = _verdict(placed, groups, "_f", "_r")
    collided = check_hits(rows, verdict).select("doc_id").distinct()
    copies = verdict.where("not (_f = xxhash64(keep_file) and _r = keep_row)").join(collided, "doc_id", "left_anti").select("_f", "_r")
    return placed.join(stored(copies, "copies"), ["_f", "_r"], "left_anti").select(*docs.columns)
