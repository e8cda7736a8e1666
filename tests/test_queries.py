"""Every query of the engine against DuckDB over the same files."""
from pathlib import Path

import duckdb
import pytest

from basalt.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r)
    got = sorted((tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=key)
    want = sorted((tuple(r) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == pytest.approx(b) if isinstance(b, float) else a == b for a, b in zip(g, w, strict=True))


def test_scan_plans_prune_and_push_down(spark):
    plan = QUERIES["where_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_totalprice" not in plan
    plan = QUERIES["join_rowids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_name" not in plan
