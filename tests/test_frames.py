"""range_frame and groups_frame: odd rows against DuckDB, and no window over a whole nation."""

import random

import duckdb
import pytest

from lakeloom.plans import catalogue

NAMES = ["groups_frame", "range_frame"]


def odd():
    """Keys about the ends of stretches, below 0, repeated and null; a nation that most rows have, null nations and segments."""
    r = random.Random(6)
    keys = [e + d for e in (-65536, 0, 65536, 131072, 1 << 40) for d in range(-120, 121)] + [None, None, 7, 7, 65535, 65535]
    return [(k, r.choice([1, 1, 1, 2, None]), r.choice(["A", "B", "C", "D", None])) for k in keys] + [(5, 3, "A"), (6, 4, None)]


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_mktsegment string").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def table(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("rows", [odd(), []], ids=["odd", "empty"])
@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, tmp_path, name, rows):
    folder = saved(spark, tmp_path, rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{folder}/customer.parquet/*.parquet')")
    assert table(catalogue.QUERIES[name](spark, folder).collect()) == table(db.execute(catalogue.DUCK[name]).fetchall())


def windows(plan):
    kids = [plan.children().apply(i) for i in range(plan.children().size())]
    return [x for k in kids for x in windows(k)] + [plan] * (plan.nodeName() == "Window")


@pytest.mark.parametrize("name", NAMES)
def test_no_window_over_a_whole_nation(spark, tmp_path, name):
    found = windows(catalogue.QUERIES[name](spark, saved(spark, tmp_path, odd()))._jdf.queryExecution().optimizedPlan())
    assert found and all("Aggregate" in w.toString() or w.partitionSpec().size() == 2 for w in found)
