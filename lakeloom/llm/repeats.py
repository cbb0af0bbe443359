"""Which hashes occur more than once in a corpus, as a bitmap of fixed size.

Counting needs one shuffle of hashes, after partial aggregation. The bitmap lets a second pass over the texts emit only
what may be repeated. Its size doesn't depend on the data: where so many hashes repeat that it fills up, the
second pass emits more than it need, and what it emits is compared exactly in any case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, LEVEL_BITS = 26, 24


def _collected(rows: DataFrame, bits: dict[int, int]) -> dict[int, np.ndarray]:
    """Bitmaps of rows (level, p), p from 1 on."""
    got = rows.groupBy("level", F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()
    out: dict[int, np.ndarray] = {}
    for r in got:
        m = out.setdefault(r["level"], np.zeros(max(4096, (1 << bits.get(r["level"], LEVEL_BITS)) // 8), np.uint8))
        m[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def repeated(hashes: DataFrame, col: str = "h", bits: int = BITS) -> np.ndarray:
    """2**bits / 8 bytes: bit (h mod 2**bits) is set for every hash that occurs at least twice. At most 2**bits / 8 bytes reach the driver."""
    again = hashes.groupBy(col).count().filter("count > 1").select(F.lit(0).alias("level"), (F.col(col).bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("p"))
    return _collected(again, {0: bits}).get(0, np.zeros(max(4096, (1 << bits) // 8), np.uint8))


def frequencies(hashes: DataFrame, col: str = "h") -> list[np.ndarray]:
    """Bitmaps of the hashes that occur 2 or 3 times (and of all more frequent ones), 4 to 15 times, 16 to 63 times and so on.

    They tell rare from frequent, if not exactly: one order for all who use them. At most 33 levels of fixed size.
    """
    counts = hashes.groupBy(col).count().filter("count > 1")
    level = F.floor(F.log("count") / F.log(F.lit(4.0)) + 1e-9).cast("int")
    h = F.col(col)
    every = counts.select(h.alias("h"), F.explode(F.array_distinct(F.array(F.lit(0), level))).alias("level"))
    p = F.when(F.col("level") == 0, F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))).otherwise(F.col("h").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))) + 1
    got = _collected(every.select("level", p.alias("p")), {0: BITS})
    return [got.get(k, np.zeros(4096, np.uint8)) for k in range(max(got, default=0) + 1)]


def levels(bitmaps: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """The highest level that each hash is in, -1 where it is in none, that is, surely occurs once."""
    out = np.where(maybe(bitmaps[0], h), 0, -1)
    for k, m in enumerate(bitmaps[1:], 1):
        out[maybe(m, h) & (out >= 0)] = k
    return out


def maybe(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64 or int64) may occur more than once."""
    p = h.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
