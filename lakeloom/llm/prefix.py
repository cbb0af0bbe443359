"""Running sums and ranks that need no single task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the rows before, within keys, in order of (bucket, *order).

    Rows of one bucket are sorted together; the totals of a key's buckets, one row each, give each bucket's start.
    keys and bucket must not be null. With value 1 it is a rank from 0.
    """
    df = df.withColumn("_v", value.cast("bigint"))
    by = [*keys, bucket]
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy(bucket)
    totals = df.groupBy(*by).agg(F.sum("_v").alias("_t"))
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.coalesce(F.sum("_t").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    cond = None
    for i, k in enumerate(by):
        c = F.col(k) == F.col(f"_k{i}")
        cond = c if cond is None else cond & c
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, cond).withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return out.drop("_v", "_start", *[f"_k{i}" for i in range(len(by))])
