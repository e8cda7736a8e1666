import hashlib
import re

import pytest
from pyspark.sql import functions as F

from basalt.llm import exactdedup
from basalt.llm.queries import ORACLES, QUERIES


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ROWS = [(5, "a  b"), (3, "a\tb"), (9, " a b"), (1, None), (2, ""), (7, " "), (8, "\n\v\f"), (4, "a b"), (6, "é" * 50000), (10, "é" * 50000), (11, "a\x1cb"), (12, None)]


@pytest.fixture
def path(spark, tmp_path):
    p = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, digest string").repartition(3).write.parquet(p)
    return p


def expect(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, min(g := groups[norm(t)]), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_cases(spark, path):
    got = exactdedup.deduplicate(spark, path)
    assert sorted(map(tuple, got.collect())) == expect(ROWS)


def test_state_lasts_over_runs_and_batches(spark, path, tmp_path):
    state = str(tmp_path / "state")
    first = exactdedup.fold_stream(spark, path, 1, state)
    assert {r.group_size for r in first.collect()} == {1, 2, 3}
    spark.createDataFrame([(0, "a b", "y")], "doc_id long, text string, digest string").write.mode("append").parquet(path)
    again = exactdedup.fold_stream(spark, path, 1, state)
    assert again.where(F.col("keep_id") == 0).select("group_size").collect()[0][0] == 3


def test_collisions_are_told_apart(spark, path, monkeypatch):
    monkeypatch.setattr(exactdedup, "_digest", lambda t: F.substring(F.sha2(exactdedup.normalised(t).cast("binary"), 256), 1, 1))
    got = sorted(tuple(r)[:4] for r in exactdedup.deduplicate(spark, path).collect())
    assert got == [r[:4] for r in expect(ROWS)]


def test_repeated_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", "k"), (1, "a", "k"), (2, "A", "k"), (None, None, None)], "doc_id long, text string, digest string")
    got = exactdedup.without_copies(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.distinct().collect()))


def test_empty(spark, tmp_path):
    p = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(p)
    assert exactdedup.deduplicate(spark, p).count() == 0


def test_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(ORACLES["op4_exact_dedup"]).fetchall()
    assert sorted(map(tuple, QUERIES["op4_exact_dedup"](spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_second_run_reads_old_dated_files(spark, tmp_path):
    import os

    path, state = tmp_path / "docs", str(tmp_path / "state")
    spark.createDataFrame([(2, "a"), (3, "b")], "doc_id long, text string").coalesce(1).write.parquet(str(path))
    exactdedup.fold_stream(spark, str(path), state_dir=state)
    seen = set(path.glob("*.parquet"))
    spark.createDataFrame([(1, "a"), (4, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(path))
    for f in set(path.glob("*.parquet")) - seen:
        os.utime(f, (f.stat().st_mtime - 30 * 86400,) * 2)
        (path / f".{f.name}.crc").unlink(missing_ok=True)
    got = exactdedup.fold_stream(spark, str(path), state_dir=state).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(1, 2), (3, 1), (4, 1)]
