"""Managed tables, scans, aggregates, joins, SQL and its errors, recovery and the text surfaces."""
import io
import socket
import threading

import pytest

from basalt import ColType, Engine, EngineError, Predicate
from basalt.cli import main
from basalt.sources import managed
from basalt.streaming import repl, server

P = Predicate


@pytest.fixture
def e(spark):
    with Engine(spark) as engine:
        yield engine


def make(e, path, kinds, rows):
    e.create_table(str(path), kinds)
    rows = list(rows)
    if rows:
        e.insert_many(str(path), rows)
    return str(path)


def test_engine_fixture(e, tmp_path):
    t = make(e, tmp_path / "t", 3, ((i % 10, i, i + 1) for i in range(1000)))
    assert len(e.scan_eq(t, 0, 3)) == 100
    assert e.scan_between(t, 1, 100, 199) == list(range(100, 200))
    assert e.scan_between(t, 1, 199, 100) == []
    assert (e.sum(t, 2), e.min(t, 1), e.max(t, 1)) == (500500, 0, 999)
    assert e.group_count(t, 0) == dict.fromkeys(range(10), 100)
    assert e.group_sum(t, 0, 1) == {k: 49500 + 100 * k for k in range(10)}
    assert e.group_avg(t, 0, 1) == {k: 495 + k for k in range(10)}
    assert e.group_min(t, 0, 1)[0] == 0 and e.group_max(t, 0, 1)[0] == 990
    assert (e.num_columns(t), e.rows_recorded(t), e.live_rows(t), e.col_type(t, 0)) == (3, 1000, 1000, ColType.UINT32)


def test_join_keeps_multiplicities(e, tmp_path):
    a = make(e, tmp_path / "a", 2, ((i % 5, i) for i in range(20)))
    b = make(e, tmp_path / "b", 2, ((i % 5, 2 * i) for i in range(10)))
    pairs = e.join(a, 0, b, 0)
    assert pairs == sorted((i, j) for i in range(20) for j in range(10) if i % 5 == j % 5) and len(pairs) == 40
    x = make(e, tmp_path / "x", 1, [(1,), (2,), (3,)])
    y = make(e, tmp_path / "y", 1, [(2,), (3,), (4,)])
    assert e.join(x, 0, y, 0) == [(1, 0), (2, 1)]


def test_compound_where_and_deletes(e, spark, tmp_path):
    t = make(e, tmp_path / "t", 3, ((i % 100, i, i % 7) for i in range(10000)))
    assert len(e.where_and(t, [P.eq(0, 17), P.between(1, 5000, 5999)])) == 10
    assert e.where_and(t, [P.eq(0, 999), P.between(1, 5000, 5999)]) == []
    assert len(e.where_and(t, [])) == 10000 and e.where_or(t, []) == []
    assert len(e.where_or(t, [P.eq(0, 1), P.eq(0, 2)])) == 200
    e.delete_many(t, spark.range(0, 10000, 5))
    assert e.live_rows(t) == 8000 and e.scan_eq(t, 0, 10) == []
    assert len(e.where_and(t, [P.eq(0, 3), P.between(1, 1000, 9000)])) == 80
    assert len(e.where_or(t, [P.between(1, 0, 4999), P.between(1, 5000, 9999)])) == 8000


CITY = [("SF", 29, 0), ("NYC", 31, 1), ("LA", 22, 1), ("NYC", 45, 0), ("SEA", 38, 1), ("NYC", 27, 0)]


def test_typed_predicates_and_errors(e, tmp_path):
    t = make(e, tmp_path / "t", ["STRING", "UINT32", "UINT32"], CITY)
    assert e.where_and(t, [P.eq_string(0, "NYC"), P.between(1, 30, 50)]) == [1, 3]
    assert e.where_or(t, [P.eq_string(0, "SEA"), P.eq(2, 0)]) == [0, 3, 4, 5]
    for preds, message in (
        ([P.eq(0, 1)], "numeric predicates require UINT32 columns"), ([P.eq(1, 1), P.eq(0, 1)], "numeric predicates require UINT32 columns"),
        ([P.eq(9, 1)], "predicate column index out of bounds"), ([P.between(1, 50, 30)], "BETWEEN predicates require lo <= hi"),
        ([P.eq_string(1, "x")], "string predicates require STRING columns"), (["x"], "expected a Predicate"),
    ):
        for where in (e.where_and, e.where_or):
            with pytest.raises(ValueError, match=message):
                where(t, preds)


def test_types_round_trip_and_reopen(e, spark, tmp_path):
    t = make(e, tmp_path / "t", list(ColType), [])
    rows = [[7, -1234, 1.5, 2.718281828, "cafe ☕"], [2**32 - 1, 2**63 - 1, -0.5, -1e300, ""]]
    assert [e.insert(t, r) for r in rows] == [0, 1]
    again = Engine(spark)
    assert [again.fetch_row(t, i) for i in (0, 1)] == rows
    assert again.fetch_row(t, 1, 2) == rows[1][:2]
    assert again.scan_eq_string(t, 4, "cafe ☕") == [0] and again.scan_eq_string(t, 4, "") == [1]
    assert again.max(t, 1) == 2**63 - 1 and again.min(t, 2) == -0.5
    again.open_table(t, list(ColType))
    with pytest.raises(ValueError):
        again.open_table(t, ["UINT32"])


@pytest.mark.parametrize("kind, bad", [("UINT32", -1), ("UINT32", 2**32), ("UINT32", "1"), ("UINT32", None), ("INT64", 2**63), ("STRING", 5), ("DOUBLE", "x"), ("UINT32", True)])
def test_values_outside_their_type(e, tmp_path, kind, bad):
    t = make(e, tmp_path / "t", [kind], [])
    with pytest.raises(ValueError):
        e.insert(t, [bad])
    assert e.rows_recorded(t) == 0


def test_engine_errors(e, spark, tmp_path):
    t = make(e, tmp_path / "t", 1, [(1,)])
    with pytest.raises(ValueError):
        e.insert(t, [1, 2])
    for bad in (-1, 70000):
        with pytest.raises(ValueError):
            P.eq(bad, 1)
    with pytest.raises(ValueError):
        P.eq_string(0, 5)
    with pytest.raises(ValueError):
        e.sum(t, 99)
    with pytest.raises(EngineError):
        e.fetch_row(t, 5)
    with pytest.raises(EngineError, match="table does not exist"):
        e.live_rows(str(tmp_path / "none"))
    assert not list(tmp_path.glob("none*"))
    other = Engine(spark)
    other.close()
    other.close()
    with pytest.raises(EngineError):
        other.live_rows(t)


def test_sums_and_keys_past_32_bits(e, tmp_path):
    t = make(e, tmp_path / "t", 2, [(2**32 - 1, 2**32 - 1)] * 3)
    assert e.sum(t, 1) == 3 * (2**32 - 1)
    assert e.sum(t, 1, wrap_u32=True) == 3 * (2**32 - 1) % 2**32
    assert e.group_count(t, 0) == {2**32 - 1: 3}


def test_empty_table(e, tmp_path):
    t = make(e, tmp_path / "t", 2, [])
    assert (e.sum(t, 0), e.min(t, 0), e.max(t, 0)) == (0, 2**32 - 1, 0)
    assert e.group_count(t, 0) == {} and e.join(t, 0, t, 0) == [] and e.scan_eq(t, 0, 1) == []
    assert e.sql_text(f"SELECT COUNT(*) FROM '{t}'") == "count(*)\n0\n"
    assert [e.sql_text(f"SELECT {f}(c0) FROM '{t}'").split("\n")[1] for f in ("SUM", "AVG", "MIN", "MAX")] == ["0", "0", "", ""]


def test_log_checkpoint_and_row_ids(e, spark, tmp_path):
    t = make(e, tmp_path / "t", 1, [])
    for v in (10, 11, 12):
        e.insert(t, [v])
    e.delete(t, 2)
    e.delete(t, 2)
    e.delete(t, 99)
    e.flush(t)
    assert e.insert(t, [13]) == 3
    again = Engine(spark)
    assert [again.is_live(t, i) for i in range(4)] == [True, True, False, True]
    assert again.sum(t, 0) == 34
    again.flush(t)
    assert Engine(spark).project_rows(t, [3, 2, 0, 3], [0]) == [[13], [10], [13]]


@pytest.mark.parametrize("damage", ["unmarked", "torn", "checksum"])
def test_recovery_stops_at_the_first_bad_operation(e, spark, tmp_path, damage):
    t = make(e, tmp_path / "t", 1, [])
    for v in (55, 56, 57):
        e.insert(t, [v])
    log = tmp_path / "t.tbl/log/v=0"
    for crc in log.glob(".*.crc"):
        crc.unlink()
    op = log / "000000000001.op"
    if damage == "unmarked":
        (log / "000000000001.ok").unlink()
    else:
        op.write_text(op.read_text()[:9] if damage == "torn" else op.read_text().replace("56", "65"))
    again = Engine(spark)
    assert again.rows_recorded(t) == 1 and again.sum(t, 0) == 55
    assert again.insert(t, [58]) == 1


def test_the_log_folds_itself(e, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(managed, "LOG_LIMIT", 3)
    t = make(e, tmp_path / "t", 1, [])
    held = None
    for v in range(7):
        assert e.insert(t, [v]) == v
        held = held or e.view(t)
    e.delete(t, 0)
    assert sorted(p.name for p in (tmp_path / "t.tbl/log").iterdir() if not p.name.startswith(".")) == ["v=1", "v=2"]
    again = Engine(spark)
    assert again.table(t).recovered == 2 and again.sum(t, 0) == 21 and again.rows_recorded(t) == 7
    assert held.count() == 1


def test_create_over_a_table_resets_it(e, tmp_path):
    t = make(e, tmp_path / "t", 1, [(1,)])
    make(e, tmp_path / "t", 2, [])
    assert e.live_rows(t) == 0 and e.num_columns(t) == 2


@pytest.fixture
def people(e, tmp_path):
    return make(e, tmp_path / "people", ["UINT32", "UINT32", "STRING", "FLOAT"], [(1, 10, "alice", 1.5), (2, 20, "bob", 2.5), (2, 30, "alice", 1e6), (3, 40, "carol", 1234567.0)])


@pytest.mark.parametrize("sql, want", [
    ("SELECT c1, c2 FROM T WHERE c0 = 2", "c1\tc2\n20\tbob\n30\talice\n"),
    ("select C0 from T where c2 = 'alice'", "c0\n1\n2\n"),
    ("SELECT c0, c00 FROM T WHERE c0 = 1 OR c1 BETWEEN 30 AND 40;", "c0\tc00\n1\t1\n2\t2\n3\t3\n"),
    ("SELECT count(*) FROM T WHERE c2 = 'alice'", "count(*)\n2\n"),
    ("SELECT COUNT(c9) FROM T", "count(*)\n4\n"),
    ("SELECT sum(c1) FROM T WHERE c0 = 2", "sum(c1)\n50\n"),
    ("SELECT avg(c1) FROM T", "avg(c1)\n25\n"),
    ("SELECT max(c3) FROM T", "max(c3)\n1.23457e+06\n"),
    ("SELECT c0, count(*) FROM T GROUP BY c0", "c0\tcount(*)\n1\t1\n2\t2\n3\t1\n"),
    ("SELECT c0, sum(c1) FROM T GROUP BY c0", "c0\tsum(c1)\n1\t10\n2\t50\n3\t40\n"),
    ("SELECT c0, avg(c1) FROM T GROUP BY c0", "c0\tavg(c1)\n1\t10\n2\t25\n3\t40\n"),
])
def test_sql(e, people, sql, want):
    assert e.sql_text(sql.replace(" T", f" '{people}'")) == want


@pytest.mark.parametrize("sql, message", [
    ("SELECT c0 FROM T WHERE c0 < 1", "unexpected character: <"), ("SELECT c0 FROM 'x", "unterminated string literal"),
    ("SELECT c0 FROM T WHERE c0 = 1 AND c1 = 2 OR c0 = 3", "mixed AND/OR WHERE clauses are not supported"),
    ("SELECT x FROM T", "expected column reference like c0"), ("SELECT c70000 FROM T", "column index out of range"),
    ("SELECT c0 FROM T WHERE c0 = 4294967296", "numeric literal out of UINT32 range"), ("SELECT c0 FROM c1", "expected table path string literal"),
    ("SELECT , FROM T", "expected select item"), ("SELECT c0 T", "expected keyword FROM"), ("SELECT c0 FROM T x", "expected end of query"),
    ("SELECT c9 FROM T", "column index out of bounds"), ("SELECT *, c0 FROM T", "SELECT \\* cannot be combined with other projections"),
    ("SELECT * FROM T GROUP BY c0", "SELECT \\* with GROUP BY is not supported"),
    ("SELECT c0, count(*) FROM T WHERE c0 = 1 GROUP BY c0", "GROUP BY with WHERE is not supported in mini-SQL v1"),
    ("SELECT c0 FROM T GROUP BY c0", "GROUP BY queries require exactly one aggregate expression"),
    ("SELECT count(*), c0 FROM T GROUP BY c0", "GROUP BY queries must select the group key first"),
    ("SELECT c2, sum(c1) FROM T GROUP BY c2", "GROUP BY v1 supports UINT32 key/value columns only"),
    ("SELECT c2, count(*) FROM T GROUP BY c2", "GROUP BY v1 supports UINT32 key columns only"),
    ("SELECT c0, count(*) FROM T", "aggregate queries cannot mix aggregates with plain columns"),
    ("SELECT count(*), sum(c1) FROM T", "non-grouped aggregate queries support exactly one aggregate"),
    ("SELECT sum(c2) FROM T", "aggregate functions require numeric columns"), ("SELECT c0 FROM T WHERE c2 = 1", "numeric predicates require UINT32 columns"),
    ("SELECT c0 FROM T WHERE c0 = 'x'", "string predicates require STRING columns"), ("SELECT c0 FROM T WHERE c0 BETWEEN 9 AND 1", "BETWEEN predicates require lo <= hi"),
    ("SELECT c0 FROM T WHERE c9 = 1", "column index out of bounds"), ("SELECT c0 FROM T WHERE c0 = x", "expected numeric literal"),
    ("SELECT c0 FROM T WHERE c0 1", "expected keyword BETWEEN"), ("SELECT sum c0 FROM T", r"expected \("),
])
def test_sql_errors(e, people, sql, message):
    with pytest.raises(ValueError, match=message):
        e.sql_df(sql.replace(" T", f" '{people}'"))


def test_cli(e, tmp_path, capsys):
    t = str(tmp_path / "t")
    for args in (["create", t, "2"], ["insert", t, "1", "10"], ["insert", f"{t}.tbl", "2", "20"], ["flush", t]):
        assert main(args, e) == 0
    capsys.readouterr()
    for args, want in ((["query", f"SELECT c0, c1 FROM '{t}'", "WHERE c0 = 2"], "c0\tc1\n2\t20\n"), (["select-eq", t, "0", "2"], "1\n"), (["select-between", t, "1", "20", "10"], "0\n1\n"), (["sum", t, "1"], "30\n")):
        assert main(args, e) == 0 and capsys.readouterr().out == want
    assert main(["query", "SELECT"], e) == 1 and "query error: expected select item" in capsys.readouterr().err


def test_repl(e, people):
    out, err = io.StringIO(), io.StringIO()
    text = f".nope\n\nSELECT c0, c1\nFROM '{people}' WHERE c0 = 1;SELECT c9 FROM '{people}';\nSELECT c0 FROM ';"
    assert repl.run(e.sql_text, io.StringIO(text), out, err) == 1
    assert "c0\tc1\n1\t10\n" in out.getvalue() and "...> " in out.getvalue()
    assert [x.split(": ", 1)[1] for x in err.getvalue().splitlines()] == ["unknown command: .nope", "column index out of bounds", "unterminated statement before EOF"]
    assert repl.run(e.sql_text, io.StringIO(".help\n.quit\n"), out, err) == 0


def test_server(e, spark, people):
    with server.make_server(lambda: Engine(spark).sql_text) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        for _ in range(2):
            with socket.create_connection(s.server_address) as c, c.makefile("rw", newline="\n") as f:
                for line, want in ((f"SELECT c0, c1 FROM '{people}' WHERE c0 = 2", "OK\nc0\tc1\n2\t20\n2\t30\nEND\n"), ("", "ERR\tempty request\nEND\n"), (f"SELECT c9 FROM '{people}'", "ERR\tcolumn index out of bounds\nEND\n"), ("SELECT c0 FROM '/nowhere/t'", "ERR\ttable does not exist\nEND\n"), (".quit", "BYE\nEND\n")):
                    f.write(line + "\n")
                    f.flush()
                    assert "".join(f.readline() for _ in want.splitlines()) == want
                assert f.readline() == ""
        s.shutdown()


def test_several_files_have_dense_row_ids(e, spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/many.parquet")
    t = f"{tmp_path}/many"
    assert [r[0] for r in e.view(t).select("_rid").orderBy("_rid").collect()] == list(range(1000))
    assert e.fetch_row(t, e.scan_eq(t, 0, 77)[0]) == [77]
    with pytest.raises(EngineError):
        e.insert(t, [1])


def test_bulk_text_sink(e, spark, people, tmp_path):
    e.sql_to_files(f"SELECT c0 FROM '{people}' WHERE c0 BETWEEN 0 AND 4000000000", str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["c0"] and back.count() == e.live_rows(people)


def test_server_answers_line_by_line():
    def fails_late(_):
        yield "c0\n"
        yield "1\n"
        raise RuntimeError("lost")

    def fails_early(_):
        yield "c0\n"
        raise RuntimeError("bad\nmore")

    assert "".join(server.answer(lambda _: ["c0\n"], "q")[0]) == "OK\nc0\nEND\n"
    assert "".join(server.answer(fails_early, "q")[0]) == "ERR\tbad\nEND\n"
    got = []
    with pytest.raises(RuntimeError):
        got.extend(server.answer(fails_late, "q")[0])
    assert got == ["OK\n", "c0\n", "1\n"]


def test_extremes_come_from_footers(e, spark, tmp_path):
    at = str(tmp_path / "o")
    spark.range(-5, 995, 1, 3).selectExpr("id AS a", "id / 2.0 AS b", "CAST(NULL AS INT) AS n").write.parquet(f"{at}.parquet")
    assert (e.min(at, 0), e.max(at, 0), e.min(at, 1), e.min(at, 2)) == (-5, 994, -2.5, None)
    assert "PushedAggregation: [MIN" in e.extreme_df(at, "min", 0)._jdf.queryExecution().toString()
    bare = str(tmp_path / "bare")
    spark.range(9).write.option("parquet.column.statistics.enabled", "false").parquet(f"{bare}.parquet")
    assert (e.min(bare, 0), e.max(bare, 0)) == (0, 8)
    with pytest.raises(ValueError):
        e.min(at, 3)
