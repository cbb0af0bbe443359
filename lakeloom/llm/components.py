"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, root) for every node of edges (u, v) but the roots; root is the least node of the component.

    Each round is written to the shared folder, so that lineage doesn't grow; the former round is then dropped. A hub's least
    neighbour comes from partial aggregation, and reaches the hub's edges by a join that splits skewed keys.
    """

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.min("v").alias("m"))

    def distinct(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").distinct()

    now = scratch.keep(distinct(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), f"{name}0")
    state, r = None, 0
    while True:
        # large star: every larger neighbour of x points at the least of x and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = distinct(both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))
        large = scratch.keep(large, f"{name}large{r}")
        # small star: x and its smaller neighbours point at the least of them
        low = least(large)
        small = distinct(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))
        r += 1
        new = scratch.keep(small, f"{name}{r}")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        scratch.drop(f"{name}{r - 1}", f"{name}large{r - 1}")
        if (row[0], row[1]) == state:
            return new.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state, now = (row[0], row[1]), new
