"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm medians, one JSON line."""
import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from basalt.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("where_eq", "where_between", "where_eq_string", "where_and", "where_or", "sum_col", "min_col", "max_col", "group_count", "group_sum", "group_avg", "group_count_highcard", "join_rowids", "sql_group_count", "sql_where_and")
RUNS = 5


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "sum of warm medians of headline queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
