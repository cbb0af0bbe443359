"""Bulk-synchronous best-fit packing of token runs into sequences of one capacity.

Documents longer than the capacity give full pieces, each a sequence of its own, and a rest. Rests and
short documents are items. In each round items and the gaps of open sequences are range-sorted by size, and a sweep upwards through every
range matches each gap with the largest item not yet taken that fits it: items go on a stack, a gap takes the top. Conflicts go by rank: the smaller
gap, then the lower sequence number, chooses first. What a range leaves, gaps that found its stack empty and items that no gap took, is matched
across ranges by the same rule on counts: a gap's successor is the last item left in the nearest range below. Gaps are updated and the next round
begins; sequences are opened for items that fit no gap.

Ranges are cut by (size, kind, hash), so that a size that a third of all documents have is many tasks. The driver holds two counts for each range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, StructField, StructType

from .frames import kind, position
from .prefix import running
from .scratch import Scratch

ITEM, GAP = 0, 1
PLACED, ITEM_LEFT, GAP_LEFT = 0, 1, 2
ORDER = ["size", "kind", "key", "n", "u"]


def match(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gap, item) places that match in a sorted run of items and gaps, and the places of gaps and items that are left, all in order."""
    cuts = np.append(0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1) if len(kinds) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(kinds))
    stack: list[list[int]] = []
    gaps, items, alone = [], [], []
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=False):
        if kinds[a] == ITEM:
            stack.append([a, b])
            continue
        while a < b and stack:
            s = stack[-1]
            m = min(b - a, s[1] - s[0])
            gaps.append(np.arange(a, a + m))
            items.append(np.arange(s[1] - 1, s[1] - 1 - m, -1))
            a, s[1] = a + m, s[1] - m
            if s[0] == s[1]:
                stack.pop()
        if a < b:
            alone.append(np.arange(a, b))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(gaps), cat(items), cat(alone), cat([np.arange(*s) for s in stack])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by ORDER -> placed items, and what is left with its rank."""
    every = [b for b in batches if b.num_rows]
    if not every:
        return
    t = pa.Table.from_batches(every).combine_chunks()
    part = TaskContext.get().partitionId()
    gaps, items, alone, left = match(t["kind"].to_numpy())
    for what, rows, at in ((PLACED, items, gaps), (ITEM_LEFT, left, None), (GAP_LEFT, alone, None)):
        own = t.take(pa.array(rows))
        gap = t.take(pa.array(rows if at is None else at))
        none = pa.nulls(len(rows), pa.int64())
        yield from pa.table(
            {
                "what": pa.array(np.full(len(rows), what, np.int8)),
                "part": pa.array(np.full(len(rows), part, np.int32)),
                "rank": pa.array(np.arange(len(rows), dtype=np.int64)),
                "id": own["id"],
                "n": own["n"],
                "u": own["u"],
                "size": own["size"] if what != GAP_LEFT else none.cast(pa.int32()),
                "seq": gap["key"] if what != ITEM_LEFT else none,
                "gap": gap["size"] if what != ITEM_LEFT else none.cast(pa.int32()),
            }
        ).to_batches()


def across(counts: dict[tuple[int, int], int]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], dict[int, int]]:
    """Matches of what the ranges leave, from how many (part, what) leaves.

    (gap part, first gap rank, gaps, item part, rank of the first item), ranks of items going down; gaps that match, from rank 0, and items that stay, from rank 0, of each part.
    """
    stack: list[list[int]] = []
    out, matched = [], {}
    for part in sorted({p for p, _ in counts}):
        rank, there = 0, counts.get((part, GAP_LEFT), 0)
        while rank < there and stack:
            below, n = stack[-1]
            m = min(n, there - rank)
            out.append((part, rank, m, below, n - 1))
            rank += m
            if m == n:
                stack.pop()
            else:
                stack[-1][1] -= m
        matched[part] = rank
        if n := counts.get((part, ITEM_LEFT), 0):
            stack.append([part, n])
    return out, matched, dict(map(tuple, stack))


def to_open(beyond: int, many: int, capacity: int, first: bool, slack: float, turns: int) -> int:
    """Sequences opened before a round for the many items, beyond tokens in all, that are larger than every gap.

    As many as their sum fills and slack more, and after the first round at least one for every turns of them, so that a few small
    items don't need as many rounds. Never more than there are such items, so that a new sequence gets an item at once.
    """
    opened = math.ceil(beyond * (1 + slack) / capacity)
    return min(many, opened if first else max(opened, -(-many // turns)))


def _schema(id_type: DataType) -> StructType:
    return StructType([StructField("what", ByteType()), StructField("part", IntegerType()), StructField("rank", LongType()), StructField("id", id_type), StructField("n", LongType()), StructField("u", LongType()), StructField("size", IntegerType()), StructField("seq", LongType()), StructField("gap", IntegerType())])


def pack(df: DataFrame, id_col: str, length: Column, capacity: int = 2048, task_rows: int = 100_000, slack: float = 0.005, turns: int = 8) -> DataFrame:
    """(id_col, piece, start, length, sequence, offset): every token of every row exactly once.

    length: a row's tokens, as a column of df; rows of null, zero or negative length have no pieces, and no text is too long. Repeated rows are packed
    as often as they come; among rows of one size the order is by a hash of the id, then the length; which of the rows that agree in these comes first
    is open. An empty table gives an empty result. Other columns of df are not read. task_rows: rows that one range should hold.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    id_type = kind(df, id_col)
    plain = df.select("*", length.cast("bigint"))
    at = position(df, id_col)
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))]).select(F.col(f"c{at}").alias("id"), F.col(f"c{len(df.columns)}").alias("n")).filter("n > 0")
    docs = scratch.keep(plain.withColumn("u", F.monotonically_increasing_id()), "docs").withColumn("key", F.xxhash64("id"))
    items = docs.withColumn("size", (F.col("n") % capacity).cast("int")).filter("size > 0").select("id", "n", "u", "key", "size")
    n_docs = docs.count()
    opened, placed, r, gaps, n_gaps, top = 0, None, 0, None, 0, 0
    while True:
        row = items.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("size") > top, F.col("size"))), F.lit(0)), F.count_if(F.col("size") > top)).collect()[0]
        if not row[0]:
            break
        new = to_open(row[1], row[2], capacity, r == 0, slack, turns)
        fresh = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).alias("gap"))
        opened, n_gaps = opened + new, n_gaps + new
        gaps = fresh if gaps is None else gaps.unionByName(fresh)
        rows = items.withColumn("kind", F.lit(ITEM).cast("tinyint")).unionByName(gaps.select(F.lit(None).cast(id_type).alias("id"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("u"), F.col("seq").alias("key"), F.col("gap").alias("size"), F.lit(GAP).cast("tinyint").alias("kind")))
        parts = max(1, min(20_000, -(-(row[0] + n_gaps) // task_rows)))
        swept = rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).select("kind", "id", "n", "u", "key", "size").mapInArrow(_sweep, _schema(id_type))
        swept = scratch.keep(swept, f"swept{r}")
        counts = {(x[0], x[1]): x[2] for x in swept.filter(F.col("what") != PLACED).groupBy("part", "what").count().collect()}
        plan, matched, stay = across(counts)
        here = spark.createDataFrame([(*p,) for p in plan], "part int, _rank bigint, _many bigint, _below int, _top bigint")
        left_gaps, left_items = swept.filter(F.col("what") == GAP_LEFT), swept.filter(F.col("what") == ITEM_LEFT)
        # at most three rows for each range
        met = left_gaps.join(F.broadcast(here), "part").filter((F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_many")))
        met = met.select("seq", "gap", F.col("_below").alias("part"), (F.col("_top") - (F.col("rank") - F.col("_rank"))).alias("rank"))
        cols = ["id", "n", "size", "seq", "gap"]
        both = swept.filter(F.col("what") == PLACED).select(*cols)
        if plan:
            both = both.unionByName(left_items.drop("seq", "gap").join(met, ["part", "rank"]).select(*cols))
        both = scratch.keep(both, f"placed{r}")
        placed = both if placed is None else placed.unionByName(both)
        bound = spark.createDataFrame([(p, matched.get(p, 0), stay.get(p, 0)) for p in {p for p, _ in counts}], "part int, _matched bigint, _stay bigint")
        items = left_items.join(F.broadcast(bound), "part").filter("rank < _stay").select("id", "n", "u", F.xxhash64("id").alias("key"), "size")
        gaps = both.select("seq", (F.col("gap") - F.col("size")).alias("gap")).filter("gap > 0").unionByName(left_gaps.join(F.broadcast(bound), "part").filter("rank >= _matched").select("seq", "gap"))
        most = gaps.agg(F.max("gap"), F.count("*")).collect()[0]
        top, n_gaps, r = most[0] or 0, most[1], r + 1
    docs = docs.withColumn("full", F.expr(f"n div {capacity}")).withColumn("bucket", F.pmod("key", F.lit(max(1, n_docs // 1_000_000))).cast("int"))
    whole = running(docs.filter("full > 0"), [], "bucket", ["key", "n", "u"], F.col("full"), "rank")
    whole = whole.select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "rank")
    out = whole.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).alias("length"), (F.lit(opened) + F.col("rank") + F.col("piece")).alias("sequence"), F.lit(0).alias("offset"))
    if placed is not None:
        out = out.unionByName(placed.select("id", F.expr(f"n div {capacity}").alias("piece"), (F.col("n") - F.col("size")).alias("start"), F.col("size").alias("length"), F.col("seq").alias("sequence"), (F.lit(capacity) - F.col("gap")).alias("offset")))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "sequence", "offset")
