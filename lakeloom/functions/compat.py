"""Functions that Spark has under no name, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Euclid's steps that two 64-bit numbers can take: consecutive Fibonacci numbers are the worst.
STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor; 0 of two zeros, null of a null."""
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % F.nullif(s["y"], F.lit(0))).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple; 0 if either is 0."""
    g = gcd(a, b)
    whole = F.call_function("div", a.cast("bigint"), F.nullif(g, F.lit(0)))
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise(F.abs(whole * b.cast("bigint")))


def trunc_number(x: Column, digits: int = 0) -> Column:
    """x without the decimals beyond digits, towards 0."""
    scale = F.lit(10.0**digits)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)).cast("double") / scale


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the stride of so many seconds, counted from origin, that holds ts (timestamp_ntz)."""
    if seconds < 1:
        raise ValueError("the stride must be a second at least")
    zero = F.lit(origin).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", zero, ts)
    width = F.lit(seconds * 1_000_000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros - F.pmod(micros, width), zero)
