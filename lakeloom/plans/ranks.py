"""The rank family over partitions of any size, without a task for each partition."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch_root


def last(order: list[str]) -> list[Column]:
    """Ascending, nulls last, as DuckDB sorts."""
    return [F.col(c).asc_nulls_last() for c in order]


def ranked(df: DataFrame, by: str, order: list[str], group: str, out: list[str], tiles: int = 4, task_rows: int = 500_000) -> DataFrame:
    """The columns out, which are among (by, *order, group), with rn and nt over (PARTITION BY by ORDER BY order), and r, dr, pr and cd over (PARTITION BY by ORDER BY group).

    Rows are range-sorted by (by, order) and stored with their range and place, so that a row number is its place in the range after those of by in former
    ranges; what the other functions need is the number of rows of each (by, group). Only counts go through windows: a row for each (range, by),
    and for each (by, group). Rows that agree in (by, order) lie in one range; among them the order, which SQL leaves open, is that of group. task_rows: rows that
    one range should hold. The stored rows stay in the shared folder.
    """
    spark = df.sparkSession
    base = f"{scratch_root(spark)}/ranks-{uuid.uuid4().hex}"

    def keep(x: DataFrame, name: str) -> DataFrame:
        x.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.schema(x.schema).parquet(f"{base}/{name}")

    names = [by, *order, group]
    df = df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    every, b, g, cols = df.columns, "c0", f"c{len(order) + 1}", [f"c{names.index(c)}" for c in out]
    ranges = max(spark.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    place = F.monotonically_increasing_id()  # the partition, and in the low 33 bits the place in it
    rows = keep(df.repartitionByRange(ranges, *last(every)).sortWithinPartitions(*last(every)).select(*dict.fromkeys([b, g, *cols]), F.shiftright(place, 33).alias("p"), place.bitwiseAND((1 << 33) - 1).alias("i")), "rows")
    counts = keep(rows.groupBy("p", F.col(b).alias("b"), F.col(g).alias("g")).agg(F.count("*").alias("n"), F.min("i").alias("i0")), "counts")  # read with its size known, so that small counts are broadcast

    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = Window.partitionBy("b").orderBy(*last(["g"]))
    runs = counts.groupBy("p", "b").agg(F.sum("n").alias("n"), F.min("i0").alias("i0"))
    runs = runs.select(F.col("p").alias("rp"), F.col("b").alias("rb"), (before(Window.partitionBy("b").orderBy("p")) + 1 - F.col("i0")).alias("shift"))
    groups = counts.groupBy("b", "g").agg(F.sum("n").alias("n"))
    groups = groups.select("b", "g", "n", (before(v) + 1).alias("r"), F.row_number().over(v).cast("bigint").alias("dr"), F.sum("n").over(Window.partitionBy("b")).alias("all"))
    found = rows.join(runs, (F.col("p") == F.col("rp")) & F.col(b).eqNullSafe(F.col("rb"))).join(groups, F.col(b).eqNullSafe(F.col("b")) & F.col(g).eqNullSafe(F.col("g")))
    pr = F.when(F.col("all") > 1, (F.col("r") - 1).cast("double") / (F.col("all") - 1).cast("double")).otherwise(F.lit(0.0))
    found = found.select(*cols, (F.col("i") + F.col("shift")).alias("rn"), "r", "dr", pr.alias("pr"), ((F.col("r") - 1 + F.col("n")).cast("double") / F.col("all").cast("double")).alias("cd"), "all")
    # the first tiles have a row more than the others; where all < tiles there are no others
    found = found.withColumn("small", F.expr(f"`all` div {tiles}")).withColumn("long", F.expr(f"`all` % {tiles} * (small + 1)"))
    nt = F.expr(f"if(rn <= long, (rn - 1) div (small + 1), `all` % {tiles} + (rn - 1 - long) div greatest(small, 1)) + 1")
    return found.select(*cols, "rn", "r", "dr", "pr", "cd", nt.alias("nt")).toDF(*out, "rn", "r", "dr", "pr", "cd", "nt")
