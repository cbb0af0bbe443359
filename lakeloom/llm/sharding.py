"""Sharding by the longest-processing-time rule.

Rows that share a key form a group that stays together. Groups, largest first, each go to the
least-loaded shard. The heap runs on the driver over *distinct sizes*, not over groups: a run of
groups of one size is dealt as a few cyclic segments, so what reaches the driver is bounded by the
number of distinct sizes, and the groups themselves are ranked and assigned by Spark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .scratch import Scratch


def lpt_segments(histogram: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first rank, ranks, cycle of shards) for each run of picks, from (size, groups of that size).

    Equal to picking from the heap once per group: the least load wins, then the lowest shard. Within
    one size a shard that has joined the cycle is picked again once in every later turn, so only the
    picks until the next shard joins need the heap. Groups of size 0 change no load, so the same shard is the
    least-loaded one for all of them.
    """
    loads = [0] * n_shards
    out: list[tuple[int, int, int, list[int]]] = []
    for size, count in sorted(histogram, reverse=True):
        heap = [(load, s) for s, load in enumerate(loads)]
        heapq.heapify(heap)
        if size == 0:
            out.append((0, 0, count, [heap[0][1]]))
            continue
        rank = 0
        cycle: list[tuple[int, int]] = []  # (load after its last pick, shard), in order of the next pick
        while rank < count:
            if not cycle or (heap and heap[0] < cycle[0]):
                load, s = heapq.heappop(heap)
                out.append((size, rank, 1, [s]))
                loads[s] = load + size
                rank += 1
                cycle.append((loads[s], s))
                # picks come in rising order of (load, shard), so the new one is the last of the turn
                cycle.sort()
                continue
            # whole turns of the cycle before the next shard of the heap comes first
            turns = (count - rank) // len(cycle)
            if heap:
                top_load, top_s = heap[0]
                behind = [(top_load - load + (s < top_s) + size - 1) // size for load, s in cycle]
                turns = min(turns, *behind)
            if turns > 0:
                out.append((size, rank, turns * len(cycle), [s for _, s in cycle]))
                rank += turns * len(cycle)
                cycle = [(load + turns * size, s) for load, s in cycle]
                for load, s in cycle:
                    loads[s] = load
            else:
                load, s = cycle.pop(0)
                out.append((size, rank, 1, [s]))
                loads[s] = load + size
                rank += 1
                cycle.append((loads[s], s))
                cycle.sort()
    return out


def lpt_shards(df: DataFrame, keys: list[Column], size: Column, id_col: str, n_shards: int) -> DataFrame:
    """(id_col, group_size, shard) for every row of df.

    keys: the columns that keep rows together; rows whose keys are all null form one group, as in GROUP BY.
    size: a row's size in whole units; null and negative sizes count as 0.
    Groups of equal size are taken in order of the 128-bit digest of their keys. Repeated rows stay in their
    group and are returned as often as they came. Texts of any length count whole. An empty table gives an empty result. Other columns of df
    are not read. Ranks within one size are taken by prefixes of the digest, so that a size that most groups have is many tasks.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "lpt")
    parts = [c for k in keys for c in (F.coalesce(k.cast("string"), F.lit("")), k.isNull().cast("string"))]
    rows = scratch.keep(df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.concat_ws("\x01", *parts))).alias("g"), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("n")), "rows")
    groups = scratch.keep(rows.groupBy("g").agg(F.sum("n").alias("n")), "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("n").count().collect()]
    segments = lpt_segments(histogram, n_shards)
    plan = spark.createDataFrame(segments or [(0, 0, 0, [0])], "size bigint, first bigint, ranks bigint, cycle array<int>")
    # two digits of the digest for up to some 10^7 groups, then more: order by them is order by the digest
    digits = 2 if sum(c for _, c in histogram) < 1 << 24 else 4
    ranked = running(groups.withColumn("bucket", F.substring(F.hex("g"), 1, digits)), ["n"], "bucket", ["g"], F.lit(1), "rank")
    placed = ranked.join(plan, (F.col("n") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks")))
    shard = F.element_at("cycle", (F.pmod(F.col("rank") - F.col("first"), F.size("cycle")) + 1).cast("int"))
    placed = placed.select("g", F.col("size").alias("group_size"), shard.alias("shard"))
    return rows.select("id", "g").join(placed, "g").select(F.col("id").alias(id_col), "group_size", "shard")
