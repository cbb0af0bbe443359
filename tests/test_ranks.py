"""rank_family: odd rows against DuckDB, with ranges of a few rows, and no window over the table's rows."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.plans import catalogue, ranks
from lakeloom.sources.storage import scratch_root

SCHEMA = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def odd(n):
    """A status that most rows have, one of a single row, one of three, null statuses, prices and priorities, equal prices."""
    r = random.Random(5)
    rows = [(k, r.choice(["F", "F", "F", "O", None]), r.choice([None, float("nan"), -1.0, 0.0, 7.5, 7.5, 7.5, r.random() * 1e6]), r.choice([None, "", "1-URGENT", "5-LOW"])) for k in range(n)]
    return [*rows, (n, "P", 1.0, "1-URGENT"), *[(n + 1 + k, "", None, None) for k in range(3)]]


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def by_duckdb(folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    return sorted(db.execute(catalogue.DUCK["rank_family"]).fetchall())


@pytest.mark.parametrize("n", [0, 1, 900])
def test_odd_rows_equal_duckdb(spark, tmp_path, n):
    folder = saved(spark, tmp_path, odd(n))
    assert sorted(map(tuple, catalogue.QUERIES["rank_family"](spark, folder).collect())) == by_duckdb(folder)


@pytest.mark.parametrize("task_rows", [7, 100])
def test_small_ranges_change_nothing(spark, tmp_path, task_rows):
    folder = saved(spark, tmp_path, odd(900))
    out = ranks.ranked(spark.read.parquet(f"{folder}/orders.parquet"), "o_orderstatus", ["o_totalprice", "o_orderkey"], "o_orderpriority", ["o_orderkey"], task_rows=task_rows)
    out = out.withColumns({c: F.round(c, 6) for c in ("pr", "cd")})
    assert sorted(map(tuple, out.collect())) == by_duckdb(folder)


def test_empty_table(spark, tmp_path):
    assert catalogue.QUERIES["rank_family"](spark, saved(spark, tmp_path, [])).collect() == []


def windows(plan):
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    return [x for k in kids for x in windows(k)] + [plan] * (plan.nodeName() == "Window")


def test_windows_are_over_counts(spark, tmp_path):
    out = catalogue.QUERIES["rank_family"](spark, saved(spark, tmp_path, odd(50)))
    found = windows(out._jdf.queryExecution().optimizedPlan())
    assert found and all("Aggregate" in w.toString() for w in found)


def test_one_status_is_many_ranges(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("k"), F.lit("O").alias("s"), F.lit(1.5).alias("price"), F.lit("low").alias("g"))
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = ranks.ranked(df, "s", ["price", "k"], "g", ["k"], task_rows=200)
    (name,) = set(os.listdir(root)) - before
    sizes = [r["count"] for r in spark.read.parquet(f"file://{root}/{name}/rows").groupBy("p").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 600
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(k, k + 1, 1, 1, 0.0, 1.0, k // 1000 + 1) for k in range(4000)]
