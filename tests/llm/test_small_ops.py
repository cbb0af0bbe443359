"""Sharding, mixing and packing against brute force, and the cases that each docstring defines."""

import bisect
import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import mixing, packing, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, shard int, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], DOCS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 9))
def test_lpt_segments_equal_a_heap(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    want = []
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        want.append((size, s))
        heapq.heappush(heap, (load + size, s))
    got = []
    for size, _, ranks, cycle in sharding.lpt_segments(list(Counter(sizes).items()), shards):
        got += [(size, cycle[i % len(cycle)]) for i in range(ranks)]
    assert got == want


def test_sharding(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "c"]) * r.randint(0, 40), "en", "s", 1) for i in range(300)]
    rows += [(400 + i, f"same size {i:05}", "en", "s", 1) for i in range(300)]
    rows += [(None, None, None, None, None), (304, None, "x", None, 2), (301, "", "en", "s", 0), (302, "z" * 100000, "en", "s", 1), (302, "z" * 100000, "en", "s", 1)]
    got = sharding.lpt_shards(docs(spark, rows), [F.col("text")], F.octet_length("text"), "doc_id", 5).collect()
    assert Counter(g.doc_id for g in got) == Counter(x[0] for x in rows)
    by_id = {g.doc_id: g for g in got if g.doc_id is not None}
    sizes: dict = defaultdict(int)
    for _, text, *_ in rows:
        sizes[text] += len(text or "")
    key = lambda t: hashlib.md5(((t or "") + "\x01" + ("true" if t is None else "false")).encode()).digest()
    heap, want = [(0, s) for s in range(5)], {}
    for text in sorted(sizes, key=lambda t: (-sizes[t], key(t))):
        load, s = heapq.heappop(heap)
        want[text] = s
        heapq.heappush(heap, (load + sizes[text], s))
    for i, text, *_ in rows:
        if i is not None:
            assert (by_id[i].shard, by_id[i].group_size) == (want[text], sizes[text])
    zero = [(1, "ab", "", "", 1), (2, "", "", "", 1), (3, None, "", "", 1)]
    got = {x.doc_id: x.shard for x in sharding.lpt_shards(docs(spark, zero), [F.col("text")], F.octet_length("text"), "doc_id", 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1}
    assert sharding.lpt_shards(docs(spark, []), [F.col("text")], F.lit(1), "doc_id", 5).collect() == []
    with pytest.raises(ValueError):
        sharding.lpt_shards(docs(spark, []), [F.col("text")], F.lit(1), "doc_id", 0)


def test_budgets_prefer_siblings():
    leaves = {("w", "en", "a"): 100, ("w", "en", "b"): 10, ("w", "fr", "c"): 1000, ("k", "en", "d"): 1000}
    got = mixing.leaf_budgets(leaves, 800, {}, 1)
    # w and k share 400 each; en of w should give 200 but has 110; the rest goes to fr, its sibling, not to k
    assert got == {("w", "en", "a"): 100, ("w", "en", "b"): 10, ("w", "fr", "c"): 290, ("k", "en", "d"): 400}
    assert mixing.leaf_budgets(leaves, 10**6, {}, 1) == leaves
    assert mixing.leaf_budgets(leaves, 300, {("w",): 0}, 2) == {("w", "en", "a"): 0, ("w", "en", "b"): 0, ("w", "fr", "c"): 0, ("k", "en", "d"): 300}
    assert mixing.leaf_budgets({}, 10, {}, 1) == {}


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["s1", "s2", None]), 1) for i in range(400)]
    rows += [(5, "w w", "en", "s1", 1), (5, "w w", "en", "s1", 1), (900, None, "en", "s1", 1), (901, "", "en", "s1", 1), (902, "w " * 50000, "en", "s1", 1), (None, "w w w", "fr", "s2", 1)]
    for fraction, epochs in ((0.4, 1), (1.7, 3)):
        got = mixing.mix(docs(spark, rows), [F.col("lang"), F.col("source")], mixing.tokens(F.col("text")), "doc_id", fraction=fraction, max_epochs=epochs, buckets=4).collect()
        leaves: dict = defaultdict(list)
        for i, text, lang, source, _ in rows:
            if text and text.split():
                leaves[lang, source].append((i, len(text.split())))
        have = {k: sum(n for _, n in v) for k, v in leaves.items()}
        budgets = mixing.leaf_budgets(have, int(round(fraction * 10) * sum(have.values()) // 10), {}, epochs)
        want: Counter = Counter()
        for (lang, source), b in budgets.items():
            leaf = f"{lang or chr(92) + 'N'}/{source or chr(92) + 'N'}"
            full, rest = divmod(b, have[lang, source])
            for e in range(full):
                want.update((i, leaf, e, n, n) for i, n in leaves[lang, source])
            h = lambda i: hashlib.md5(f"17:{full}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
            at = 0
            # buckets are cut from the hash, so their order is the order of the hash
            for i, n in sorted(leaves[lang, source], key=lambda x: (h(x[0]), x[0] is not None, x[0] or 0, x[1])):
                if at < rest:
                    want[i, leaf, full, n, min(n, rest - at)] += 1
                at += n
        assert Counter((g.doc_id, g.leaf, g.epoch, g.n_tokens, g.take_tokens) for g in got) == want
        assert sum(g.take_tokens for g in got) == sum(budgets.values())
    assert mixing.mix(docs(spark, []), [F.col("lang")], F.lit(1), "doc_id").collect() == []


def best_fit(items, capacity, slack=0.005, turns=8):
    """The rounds one by one. items: (size, *order) -> {item: (sequence, offset)}. Every gap in rising order takes the largest item left that fits."""
    left, gaps, placed, opened, r = sorted(items), [], {}, 0, 0
    while left:
        top = max((g for g, _ in gaps), default=0)
        large = [x[0] for x in left if x[0] > top]
        new = math.ceil(sum(large) * (1 + slack) / capacity)
        new = min(len(large), new if r == 0 else max(new, -(-len(large) // turns)))
        gaps = sorted(gaps + [(capacity, opened + k) for k in range(new)])
        opened, r, after = opened + new, r + 1, []
        for g, seq in gaps:
            k = bisect.bisect_right(left, (g, math.inf)) - 1
            if k < 0:
                after.append((g, seq))
                continue
            x = left.pop(k)
            placed[x] = (seq, capacity - g)
            if g > x[0]:
                after.append((g - x[0], seq))
        assert new or len(after) < len(gaps) or len(placed)
        gaps = after
    return placed, opened


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=60), st.integers(1, 6))
def test_sweeps_over_ranges_are_one_sweep(rows, parts):
    rows = sorted((s, int(g), k) for k, (s, g) in enumerate(rows))
    want, stack = {}, []
    for x in rows:
        if x[1] == packing.ITEM:
            stack.append(x)
        elif stack:
            want[x] = stack.pop()
    step = -(-len(rows) // parts) or 1
    got, left = {}, {}
    for p in range(parts):
        mine = rows[p * step : (p + 1) * step]
        gaps, items, alone, rest = packing.match(np.array([x[1] for x in mine], np.int8))
        got |= {mine[g]: mine[i] for g, i in zip(gaps, items, strict=True)}
        left[p, packing.GAP_LEFT], left[p, packing.ITEM_LEFT] = [mine[i] for i in alone], [mine[i] for i in rest]
    plan, matched, stay = packing.across({k: len(v) for k, v in left.items() if v})
    for gp, first, many, ip, top in plan:
        got |= {left[gp, packing.GAP_LEFT][first + k]: left[ip, packing.ITEM_LEFT][top - k] for k in range(many)}
    assert got == want
    assert sum(stay.values()) == len(stack) and sum(matched.values()) == sum(p[2] for p in plan)


@pytest.mark.parametrize("task_rows", [40, 100_000])
def test_packing(spark, task_rows):
    r = random.Random(3)
    rows = [(i, "x", "en", "s", r.choice([1, 5, 63, 64, 65, 200, r.randint(1, 300)])) for i in range(500)]
    rows += [(1000 + i, "x", "en", "s", 17) for i in range(300)]  # a hot size
    rows += [(3, "x", "en", "s", 9), (3, "x", "en", "s", 9), (None, None, None, None, 10), (600, "x", "en", "s", None), (601, "x", "en", "s", 0), (602, "x", "en", "s", -4), (603, "x", "en", "s", 10000)]
    df = docs(spark, rows)
    got = packing.pack(df, "doc_id", F.col("n"), 64, task_rows=task_rows).collect()
    total = sum(x[4] for x in rows if x[4] and x[4] > 0)
    assert sum(g.length for g in got) == total
    seqs: dict = defaultdict(list)
    for g in got:
        seqs[g.sequence].append((g.offset, g.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert total / (64 * len(seqs)) > 0.97
    tokens = Counter()
    for g in got:
        tokens.update((g.doc_id, t) for t in range(g.start, g.start + g.length))
    want = Counter()
    for i, _, _, _, n in rows:
        want.update((i, t) for t in range(n or 0))
    assert tokens == want
    # the very sequences of the rounds done one by one
    keys = {x[0]: x[1] for x in df.select("doc_id", F.xxhash64("doc_id")).collect()}
    items = [(n % 64, keys[i], n, k) for k, (i, *_, n) in enumerate(rows) if n and n > 0 and n % 64]
    placed, opened = best_fit(items, 64)
    ids = {k: i for k, (i, *_) in enumerate(rows)}
    assert Counter((g.doc_id, g.length, g.sequence, g.offset) for g in got if g.length < 64) == Counter((ids[x[3]], x[0], *at) for x, at in placed.items())
    assert sorted(g.sequence for g in got if g.length == 64) == list(range(opened, opened + sum((x[4] or 0) // 64 for x in rows if (x[4] or 0) > 0)))
    assert packing.pack(docs(spark, []), "doc_id", F.col("n"), 64).collect() == []
    one = packing.pack(docs(spark, [(1, "x", "en", "s", 128)]), "doc_id", F.col("n"), 64).collect()
    assert sorted((g.piece, g.sequence) for g in one) == [(0, 0), (1, 1)]


def test_op5_is_best_fit(spark):
    from lakeloom.llm import queries

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", F.xxhash64("doc_id").alias("k")).collect()
    items = [(n % 2048, x.k, n, x.doc_id) for x in table if (n := len([w for w in re.split("[ \t\n\r]+", x.text or "") if w])) % 2048]
    placed, _ = best_fit(items, queries.SEQUENCE_TOKENS)
    got = {(g.doc_id, g.length): (g.sequence, g.offset) for g in queries.op5_packing(spark, d).collect() if g.length < 2048}
    assert got == {(x[3], x[0]): at for x, at in placed.items()}
