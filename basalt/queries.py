"""One query for each operator of the engine, over the tables of a data folder, and the same in DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.api import Engine
from basalt.operators import relational as R
from basalt.operators.predicates import Predicate as P
from basalt.sources.fs import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SOURCE = {c: f for f, cols in {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"),
    "events": ("event_id", "user_id", "event_type"), "customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey"),
}.items() for c in cols}


_ENGINES: dict[tuple[str, int], Engine] = {}


class _Tables:
    """Live views of a data folder's tables, and column positions by name. A folder's tables stay open
    for the session, so only the first query over a table reads its schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        key = (f"{spark.sparkContext.applicationId} {sf_dir}", id(spark))
        self.engine, self.dir, self.spark = _ENGINES.setdefault(key, Engine(spark)), sf_dir, spark

    def __getitem__(self, table: str) -> DataFrame:
        return self.engine.view(f"{self.dir}/{table}")

    def at(self, column: str) -> tuple[DataFrame, int]:
        view = self[_SOURCE[column]]
        return view, R.table_schema(view).names.index(column)

    def extreme(self, fn: str, column: str) -> DataFrame:
        return self.engine.extreme_df(f"{self.dir}/{_SOURCE[column]}", fn, self.at(column)[1])

    def new(self, name: str, kinds: Sequence[str]) -> str:
        """An empty managed table of this query's own, in the folder all of the cluster shares; a second run starts it anew."""
        spark = self.spark
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
        path = f"{shared.rstrip('/')}/basalt-{spark.sparkContext.applicationId}-{name}"
        self.engine.create_table(path, kinds)
        return path

    def ids(self, *rids: int) -> DataFrame:
        return self.spark.createDataFrame([(r,) for r in rids], f"{R.ROW_ID} bigint")

    def sql(self, text: str) -> DataFrame:
        return self.engine.sql_df(text.replace("@", f"{self.dir}/"))


def _query(oracle: str):
    def add(fn):
        name = fn.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: fn(_Tables(spark, sf_dir))
        ORACLES[name] = oracle
        return fn

    return add


def _rid(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(R.ROW_ID, "rid")


@_query("SELECT * FROM nation")
def scan_all(t):
    return R.all_columns(t["nation"])


@_query("SELECT o_orderkey AS rid FROM orders")
def live_row_ids(t):
    return _rid(R.row_ids(t["orders"]))


@_query("SELECT l_suppkey FROM lineitem")
def column_scan(t):
    return R.column_scan(*t.at("l_suppkey"))


@_query("SELECT o_orderkey AS rid, o_custkey FROM orders")
def column_with_rid(t):
    return _rid(R.column_scan(*t.at("o_custkey"), with_row_id=True))


@_query("SELECT * FROM orders WHERE o_orderkey = 42")
def fetch_row(t):
    return R.fetch(t["orders"], 42)


@_query("SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (5, 17, 4096, 14999)")
def project_rows(t):
    return R.project_rows(t["orders"], t.ids(5, 17, 4096, 14999), [1, 2])


def _nations(t, name):
    path = t.new(name, ["INT64", "STRING", "INT64"])
    t.engine.insert_many(path, R.all_columns(t["nation"]))
    return path


_NATION = "n_nationkey AS c0, n_name AS c1, n_regionkey AS c2 FROM nation"


@_query(f"SELECT {_NATION} UNION ALL SELECT 25, 'ATLANTIS', 0")
def insert_visible(t):
    path = _nations(t, "insert")
    t.engine.insert(path, (25, "ATLANTIS", 0))
    return R.all_columns(t.engine.view(path))


@_query("SELECT o_orderkey AS rid, o_orderkey AS c0, o_custkey AS c1 FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey <> 7")
def delete_rows(t):
    path = t.new("delete", ["INT64", "INT64"])
    t.engine.insert_many(path, R.project(t["orders"], [0, 1]))
    live = t.engine.view(path)
    t.engine.delete_many(path, R.row_ids(live.filter(F.col("c0") % 5 == 0)))
    t.engine.delete(path, 7)
    return _rid(t.engine.view(path))


@_query(f"SELECT {_NATION} WHERE n_nationkey <> 3 UNION ALL SELECT 26, 'LEMURIA', 1")
def flush_reopen(t):
    """Checkpointed, changed again, and read by an engine that knows the table from its files alone."""
    path = _nations(t, "flush")
    t.engine.delete(path, 3)
    t.engine.flush(path)
    t.engine.insert(path, (26, "LEMURIA", 1))
    return R.all_columns(Engine(t.spark).view(path))


@_query(f"SELECT {_NATION} UNION ALL SELECT 25, 'ATLANTIS', 0")
def recover_torn_log(t):
    """An operation whose text is torn, and all after it, never happened."""
    path = _nations(t, "recover")
    for row in ((25, "ATLANTIS", 0), (26, "LEMURIA", 1), (27, "MU", 2)):
        t.engine.insert(path, row)
    Store(t.spark).write(f"{path}.tbl/log/v=0/{2:012d}.op", "torn", replace=True)
    return R.all_columns(Engine(t.spark).view(path))


@_query("SELECT event_id AS c0, value AS c1, CAST(value AS FLOAT) AS c2, event_type AS c3, event_id AS c4 FROM events WHERE event_type = 'click' AND event_id BETWEEN 10 AND 5000")
def typed_table(t):
    """Every declared type, written and scanned by a predicate over two of them."""
    path = t.new("typed", ["UINT32", "DOUBLE", "FLOAT", "STRING", "INT64"])
    ev = t["events"]
    t.engine.insert_many(path, ev.select("event_id", "value", "value", "event_type", "event_id").toDF("a", "b", "c", "d", "e"))
    view = t.engine.view(path)
    found = R.where_and(view, [P.eq_string(3, "click"), P.between(0, 10, 5000)])
    return R.project_rows(view, found, range(5))


@_query("SELECT 'min' AS fn, 4294967295 AS value UNION ALL SELECT 'max', 0 UNION ALL SELECT 'sum', 0")
def typed_empty(t):
    """Aggregates of an empty UINT32 column: MIN is its largest number, MAX its smallest."""
    view = t.engine.view(t.new("empty", ["UINT32"]))
    parts = [R.min_column(view, 0), R.max_column(view, 0), R.sum_column(view, 0)]
    a, b, c = (p.select(F.lit(fn).alias("fn"), F.col("value").cast("bigint").alias("value")) for fn, p in zip(("min", "max", "sum"), parts, strict=True))
    return a.union(b).union(c)


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey = 17")
def where_eq(t):
    return _rid(R.where_eq(*t.at("o_custkey"), 17))


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey BETWEEN 100 AND 199")
def where_between(t):
    return _rid(R.where_between(*t.at("o_custkey"), 100, 199))


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey BETWEEN 199 AND 100")
def where_between_inverted(t):
    return _rid(R.where_between(*t.at("o_custkey"), 199, 100))


@_query("SELECT event_id AS rid FROM events WHERE event_type = 'click'")
def where_eq_string(t):
    return _rid(R.where_eq_string(*t.at("event_type"), "click"))


@_query("SELECT event_id AS rid FROM events WHERE event_type = 'nobody'")
def where_eq_string_miss(t):
    return _rid(R.where_eq_string(*t.at("event_type"), "nobody"))


_TWO = [P.between(1, 0, 99), P.between(0, 5000, 9999)]


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey BETWEEN 0 AND 99 AND o_orderkey BETWEEN 5000 AND 9999")
def where_and(t):
    return _rid(R.where_and(t["orders"], _TWO))


@_query("SELECT event_id AS rid FROM events WHERE event_type = 'purchase' AND user_id BETWEEN 10 AND 50")
def where_and_cross_type(t):
    return _rid(R.where_and(t["events"], [P.eq_string(3, "purchase"), P.between(2, 10, 50)]))


@_query("SELECT o_orderkey AS rid FROM orders")
def where_and_empty(t):
    return _rid(R.where_and(t["orders"], []))


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey BETWEEN 0 AND 99 OR o_orderkey BETWEEN 5000 AND 9999")
def where_or(t):
    return _rid(R.where_or(t["orders"], _TWO))


@_query("SELECT o_orderkey AS rid FROM orders WHERE FALSE")
def where_or_empty(t):
    return _rid(R.where_or(t["orders"], []))


def _two_sets(t):
    return R.where_between(*t.at("o_custkey"), 0, 99), R.where_between(*t.at("o_orderkey"), 5000, 0xFFFFFFFF)


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey <= 99 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderkey >= 5000")
def rowid_intersect(t):
    return _rid(R.intersect_row_ids(*_two_sets(t)))


@_query("SELECT o_orderkey AS rid FROM orders WHERE o_custkey <= 99 UNION SELECT o_orderkey FROM orders WHERE o_orderkey >= 5000")
def rowid_union(t):
    return _rid(R.union_row_ids(*_two_sets(t)))


@_query("SELECT l_returnflag, l_orderkey FROM lineitem")
def project_cols(t):
    return R.project(t["lineitem"], [8, 0])


@_query("SELECT o_orderkey AS c0, o_custkey AS c1 FROM orders WHERE o_custkey BETWEEN 1 AND 9 AND o_orderstatus = 'F'")
def sql_where_and(t):
    return t.sql("SELECT c0, c1 FROM '@orders' WHERE c1 BETWEEN 1 AND 9 AND c2 = 'F'")


@_query("SELECT o_orderkey AS c0 FROM orders WHERE o_custkey = 1 OR o_custkey = 5")
def sql_where_or(t):
    return t.sql("SELECT c0 FROM '@orders' WHERE c1 = 1 OR c1 = 5")


@_query("SELECT n_nationkey AS c0, n_name AS c1, n_regionkey AS c2 FROM nation")
def sql_star(t):
    return t.sql("SELECT * FROM '@nation';")


@_query("SELECT CAST(SUM(l_suppkey) AS BIGINT) AS s FROM lineitem")
def sum_col(t):
    return R.sum_column(*t.at("l_suppkey")).toDF("s")


@_query("SELECT CAST(SUM(l_orderkey * 1000) % 4294967296 AS BIGINT) AS s FROM lineitem")
def sum_col_wrap_u32(t):
    thousands = t["lineitem"].select((F.col("l_orderkey") * 1000).alias("c0"), R.ROW_ID)
    return R.sum_column(thousands, 0, wrap=True).toDF("s")


@_query("SELECT MIN(l_orderkey) AS m FROM lineitem")
def min_col(t):
    return t.extreme("min", "l_orderkey").toDF("m")


@_query("SELECT MAX(l_orderkey) AS m FROM lineitem")
def max_col(t):
    return t.extreme("max", "l_orderkey").toDF("m")


def _where_a(t, fn, column=None, out="m"):
    view = t["lineitem"]
    index = None if column is None else R.table_schema(view).names.index(column)
    return R.scalar_aggregate(view.filter(F.col("l_returnflag") == "A"), fn, index, out)


@_query("SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'A'")
def agg_count_where(t):
    return _where_a(t, "count", out="n")


@_query("SELECT CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem WHERE l_returnflag = 'A'")
def agg_sum_where(t):
    return _where_a(t, "sum", "l_partkey", "s")


@_query("SELECT MIN(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'A'")
def agg_min_where(t):
    return _where_a(t, "min", "l_extendedprice")


@_query("SELECT MAX(l_extendedprice) AS m FROM lineitem WHERE l_returnflag = 'A'")
def agg_max_where(t):
    return _where_a(t, "max", "l_extendedprice")


@_query("SELECT AVG(l_partkey) AS a FROM lineitem WHERE l_returnflag = 'A'")
def agg_avg_where(t):
    return _where_a(t, "avg", "l_partkey", "a")


@_query("SELECT COUNT(*) AS n, CAST(COALESCE(SUM(o_custkey), 0) AS BIGINT) AS s, COALESCE(AVG(o_custkey), 0) AS a, MIN(o_custkey) AS mn, MAX(o_custkey) AS mx FROM orders WHERE FALSE")
def agg_empty_input(t):
    return R.scalar_aggregates(t["orders"].filter(F.lit(False)), [("count", None, "n"), ("sum", 1, "s"), ("avg", 1, "a"), ("min", 1, "mn"), ("max", 1, "mx")])


def _group(t, fn, key, value=None):
    view, k = t.at(key)
    return R.group_aggregate(view, fn, k, None if value is None else t.at(value)[1], ("k", "v"))


@_query("SELECT l_linenumber AS k, COUNT(*) AS v FROM lineitem GROUP BY l_linenumber")
def group_count(t):
    return _group(t, "count", "l_linenumber")


@_query("SELECT l_linenumber AS k, CAST(SUM(l_suppkey) AS BIGINT) AS v FROM lineitem GROUP BY l_linenumber")
def group_sum(t):
    return _group(t, "sum", "l_linenumber", "l_suppkey")


@_query("SELECT l_linenumber AS k, AVG(l_suppkey) AS v FROM lineitem GROUP BY l_linenumber")
def group_avg(t):
    return _group(t, "avg", "l_linenumber", "l_suppkey")


@_query("SELECT l_linenumber AS k, MIN(l_partkey) AS v FROM lineitem GROUP BY l_linenumber")
def group_min(t):
    return _group(t, "min", "l_linenumber", "l_partkey")


@_query("SELECT l_linenumber AS k, MAX(l_partkey) AS v FROM lineitem GROUP BY l_linenumber")
def group_max(t):
    return _group(t, "max", "l_linenumber", "l_partkey")


@_query("SELECT l_orderkey AS k, COUNT(*) AS v FROM lineitem GROUP BY l_orderkey")
def group_count_highcard(t):
    return _group(t, "count", "l_orderkey")


@_query("SELECT l_returnflag AS k, COUNT(*) AS v FROM lineitem GROUP BY l_returnflag")
def group_string_key(t):
    return _group(t, "count", "l_returnflag")


def _sql_group(name, fn, arg, sql):
    out = f"{fn}({arg})"
    oracle = f'SELECT l_linenumber AS c3, {sql} AS "{out}" FROM lineitem GROUP BY l_linenumber'

    def run(t):
        return t.sql(f"SELECT c3, {fn.upper()}({arg}) FROM '@lineitem' GROUP BY c3")

    run.__name__ = name
    _query(oracle)(run)


_sql_group("sql_group_count", "count", "*", "COUNT(*)")
_sql_group("sql_group_sum", "sum", "c2", "CAST(SUM(l_suppkey) AS BIGINT)")
_sql_group("sql_group_avg", "avg", "c2", "AVG(l_suppkey)")
_sql_group("sql_group_min", "min", "c2", "MIN(l_suppkey)")
_sql_group("sql_group_max", "max", "c2", "MAX(l_suppkey)")


@_query("SELECT AVG(l_quantity) AS \"avg(c4)\" FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3")
def sql_avg_where(t):
    return t.sql("SELECT AVG(c4) FROM '@lineitem' WHERE c3 BETWEEN 2 AND 3")


@_query("SELECT o_orderkey AS left_rid, c_custkey AS right_rid FROM orders JOIN customer ON o_custkey = c_custkey")
def join_rowids(t):
    return R.join_row_ids(*t.at("o_custkey"), *t.at("c_custkey"))


@_query("SELECT s_suppkey AS left_rid, c_custkey AS right_rid FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_many_to_many(t):
    return R.join_row_ids(*t.at("s_nationkey"), *t.at("c_nationkey"))


@_query("SELECT o_orderkey AS left_rid, c_custkey AS right_rid FROM orders JOIN customer ON o_custkey = c_custkey + 1000000")
def join_no_match(t):
    far = t["customer"].withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return R.join_row_ids(*t.at("o_custkey"), far, 0)
