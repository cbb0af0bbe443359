"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of named levels (domain, language, source): siblings share their
parent's budget by weight, and what a child can't supply goes to its siblings first; only what the
whole subtree can't supply goes back to the parent's siblings. A leaf's capacity is its tokens times
max_epochs. Each leaf then gives a prefix of its tokens in the order of seeded epochs: all documents
once per full epoch, and of the last epoch the documents in the order of md5(seed:epoch:id) up to the budget.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

TOKENS = "[^ \\t\\n\\r]+"


def tokens(text: Column) -> Column:
    """White-space words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("bigint")


def fill(budget: Fraction, children: list[tuple[Fraction, int]]) -> list[Fraction]:
    """Shares of budget for (weight, capacity): by weight, and a shortage spreads over those not yet full."""
    out = [Fraction(0)] * len(children)
    live = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(budget, Fraction(sum(children[i][1] for i in live)))
    while live and left > 0:
        total = sum(children[i][0] for i in live)
        full = [i for i in live if Fraction(children[i][1]) <= left * children[i][0] / total]
        if not full:
            for i in live:
                out[i] = left * children[i][0] / total
            break
        for i in full:
            out[i] = Fraction(children[i][1])
        left -= sum(Fraction(children[i][1]) for i in full)
        live = [i for i in live if i not in set(full)]
    return out


def leaf_budgets(leaves: dict[tuple, int], budget: int, weights: dict[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf (a path of names): the floors of exact shares.

    leaves: tokens there are. weights: of any node by its path; 1 where none is given.
    """
    caps: dict[tuple, int] = {}
    kids: dict[tuple, set] = {}
    for path, there in leaves.items():
        for n in range(len(path) + 1):
            caps[path[:n]] = caps.get(path[:n], 0) + there * max_epochs
            if n:
                kids.setdefault(path[: n - 1], set()).add(path[:n])
    out: dict[tuple, int] = {}

    def down(node: tuple, share: Fraction) -> None:
        if node not in kids:
            out[node] = int(share)
            return
        below = sorted(kids[node], key=lambda p: tuple((x is None, str(x)) for x in p))
        for child, part in zip(below, fill(share, [(Fraction(weights.get(p, 1)).limit_denominator(10**6), caps[p]) for p in below]), strict=True):
            down(child, part)

    if leaves:
        down((), Fraction(budget))
    return out


def mix(df: DataFrame, levels: list[Column], n_tokens: Column, id_col: str, *, fraction: float = 0.5, budget: int | None = None, weights: dict[tuple, float] | None = None, max_epochs: int = 2, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """(id_col, leaf, epoch, n_tokens, take_tokens): each taken document once per epoch that takes it.

    budget: tokens in all; else fraction of what the table has. take_tokens is less than n_tokens only for the
    document that the budget cuts. A null level is a node of its own. Documents without tokens (null or empty text)
    are never taken. Rows that repeat an id are ordered by their tokens and each counted. An empty table or a budget
    of 0 gives an empty result. Texts of any length count whole. Ties in the hash go by id, then tokens. Other columns are not read. The tree's nodes,
    with one sum each, are brought to the driver.

    Order within an epoch needs no single task per leaf: hashes fall in equal buckets, whose totals give each
    bucket's start, and only rows of one bucket are sorted together. buckets: by default one for every 100,000 rows, 256 at least.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    names = [f"_l{i}" for i in range(len(levels))]
    flat = scratch.keep(df.select(F.col(f"`{id_col}`").alias("_id"), *[c.cast("string").alias(n) for c, n in zip(levels, names, strict=True)], n_tokens.cast("bigint").alias("_n")).filter("_n > 0"), "tokens")
    rows = flat.groupBy(*names).agg(F.sum("_n"), F.count("*")).collect()
    leaves = {tuple(r[:-2]): r[-2] for r in rows}
    buckets = buckets or max(256, 1 << (max([1, *(r[-1] for r in rows)]) // 100_000).bit_length())
    total = sum(leaves.values())
    shares = leaf_budgets(leaves, int(Fraction(fraction).limit_denominator(10**6) * total) if budget is None else budget, weights or {}, max_epochs)
    plan = [(*p, b // leaves[p], b % leaves[p]) for p, b in shares.items() if b > 0]
    plan_schema = ", ".join([*(f"_p{i} string" for i in range(len(levels))), "_full int, _rest bigint"])
    here = spark.createDataFrame(plan, plan_schema)
    cond = None
    for i, n in enumerate(names):
        c = F.col(n).eqNullSafe(F.col(f"_p{i}"))
        cond = c if cond is None else cond & c
    rows = flat.join(here, cond).select("_id", *names, "_n", "_full", "_rest")
    whole = rows.filter("_full > 0").select("_id", *names, F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("_e"), "_n", F.col("_n").alias("_take"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")))).alias("_h")
    part = rows.filter("_rest > 0").select("*", key).withColumn("_b", F.pmod(F.conv(F.substring("_h", 1, 6), 16, 10).cast("int"), F.lit(1 << 24)).cast("bigint") * buckets / (1 << 24))
    part = part.withColumn("_b", F.floor("_b").cast("int"))
    starts = part.groupBy(*names, "_b").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*[F.col(n).alias(f"_s{i}") for i, n in enumerate(names)], F.col("_b").alias("_sb"), before.alias("_start"))
    cond = F.col("_b") == F.col("_sb")
    for i, n in enumerate(names):
        cond = cond & F.col(n).eqNullSafe(F.col(f"_s{i}"))
    part = part.join(starts, cond).filter(F.col("_start") < F.col("_rest"))
    w = Window.partitionBy(*names, "_b").orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_at") < F.col("_rest"))
    part = part.select("_id", *names, F.col("_full").alias("_e"), "_n", F.least(F.col("_n"), F.col("_rest") - F.col("_at")).alias("_take"))
    leaf = F.concat_ws("/", *[F.coalesce(F.col(n), F.lit("\\N")) for n in names])
    return whole.unionByName(part).select(F.col("_id").alias(id_col), leaf.alias("leaf"), F.col("_e").alias("epoch"), F.col("_n").alias("n_tokens"), F.col("_take").alias("take_tokens"))
