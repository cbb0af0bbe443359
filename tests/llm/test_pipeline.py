"""The pipeline against a brute-force version of all five stages, and each stage on odd rows and empty tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small_ops import best_fit
from test_text_ops import naive_probability

from lakeloom.llm import mixing, near_dedup, quality_cnn, queries

P = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
LONG = "the committee of the town is on the hill " * 20000


def brute_lines(docs):
    """docs: (id, text, ...) -> the same without windows of two lines that occur before, in order of (id, line)."""
    first = {}
    lines = {d[0]: [x.rstrip("\n") for x in d[1].splitlines(keepends=True)] for d in docs if d[0] is not None and d[1]}
    for i in sorted(lines):
        for k in range(len(lines[i]) - 1):
            first.setdefault((lines[i][k], lines[i][k + 1]), (i, k))
    out = []
    for d in docs:
        gone = set()
        if d[0] is not None and d[1]:
            for k in range(len(lines[d[0]]) - 1):
                w = (lines[d[0]][k], lines[d[0]][k + 1])
                j, m = first[w]
                if "".join(w).strip(" \t\r\n\v\f") and (j != d[0] or k >= m + 2):
                    gone |= {k, k + 1}
        text = "".join(x for k, x in enumerate(d[1].splitlines(keepends=True)) if k not in gone) if gone else d[1]
        if not gone or text.strip(" \n\r\t"):
            out.append((d[0], text, *d[2:]))
    return out


def brute_near(docs):
    """Every pair of sketches; one document, the one of the least id, of each component."""
    ids, sks = [], []
    for d in docs:
        if d[0] is not None and d[1]:
            b = np.frombuffer(d[1].encode(), np.uint8)
            rows, _, mins = near_dedup.signatures(b, np.array([0, len(b)]))
            if len(rows):
                ids.append(d[0])
                sks.append(near_dedup.K.mix(mins[0].astype(np.uint64) + near_dedup.K.U(1)).astype(np.uint8))
    near = near_dedup.agreeing(np.array(sks), np.array(sks)) >= np.ceil(0.6 * near_dedup.SKETCH)
    root = {}
    order = np.argsort(ids, kind="stable")
    for i in order:
        if i not in root:
            root[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in root:
                        root[j] = i
                        todo.append(j)
    gone = {ids[i] for i, r in root.items() if ids[i] != ids[r]}
    return [d for d in docs if d[0] not in gone]


def brute_mix(docs):
    """Documents that begin inside their leaf's budget."""
    leaves = defaultdict(list)
    tokens = lambda t: len([w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]) if t else 0
    for d in docs:
        if n := tokens(d[1]):
            digits = "".join(reversed(list(_tail(d[3] or ""))))
            domain = {0: "web", 1: "books"}.get(int(digits) % 3, "code") if digits else "code"
            leaves[domain, d[2], d[3]].append((d[0], n))
    have = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budgets = mixing.leaf_budgets(have, int(P.MIX_FRACTION * 10 * sum(have.values()) // 10), queries.WEIGHTS, 1)
    taken = set()
    for leaf, b in budgets.items():
        full, rest = divmod(b, have[leaf])
        taken |= {i for i, _ in leaves[leaf]} if full else set()
        h = lambda i: hashlib.md5(f"17:{full}:{'' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        at = 0
        for i, n in sorted(leaves[leaf], key=lambda x: (h(x[0]), x[0] is not None, x[0] or 0, x[1])):
            if at < rest:
                taken.add(i)
            at += n
    return [(d[0], tokens(d[1])) for d in docs if d[0] in taken and tokens(d[1])]


def _tail(s):
    for c in reversed(s):
        if not c.isdigit():
            return
        yield c


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """sf0.001 with nulls in every column, empty and very long texts and repeated rows."""
    at = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    some = docs.filter("n_chars > 400").orderBy("doc_id").limit(3).collect()
    more = [(90001, None, "en", "src1", None), (90002, "", "en", None, 0), (None, some[0].text, None, "src1", 3), (90003, LONG, "en", "src2", len(LONG)), (90004, some[1].text, None, None, None), (90005, " \n ", "de", "src3", 3)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("where", ["plain", "odd"])
def test_pipeline_equals_brute_force(spark, odd, where):
    d = D if where == "plain" else odd
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = quality_cnn.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    rows = [(x.doc_id, x.text, x.lang, x.source) for x in docs.collect()]
    p = [None if x[1] is None else naive_probability(net, x[1].encode()) for x in rows]
    assert all(x is None or abs(x - P.QUALITY_AT_LEAST) > 1e-5 for x in p)
    rows = [x for x, q in zip(rows, p, strict=True) if q is not None and q >= P.QUALITY_AT_LEAST]
    rows = brute_mix(brute_near(brute_lines(rows)))
    keys = {x[0]: x[1] for x in docs.select("doc_id", F.xxhash64("doc_id")).collect()}
    cap = queries.SEQUENCE_TOKENS
    placed, opened = best_fit([(n % cap, keys[i], n, k) for k, (i, n) in enumerate(rows) if n % cap], cap)
    want = Counter((rows[x[3]][0], x[2] // cap, x[2] - x[0], x[0], *at) for x, at in placed.items())
    got = P.run(spark, d).collect()
    assert got and Counter(tuple(x) for x in got if x.length < cap) == want
    full = [x for x in got if x.length == cap]
    assert Counter((x.doc_id, x.piece, x.start, x.offset) for x in full) == Counter((i, k, k * cap, 0) for i, n in rows for k in range(n // cap))
    assert sorted(x.sequence for x in full) == list(range(opened, opened + len(full)))


def test_stages_on_odd_columns_repeats_and_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 9 = 0"))
    clash = docs.select("*", F.lit(1).alias("quality"), F.lit(2).alias("_quality"), F.lit("x").alias("c0"), F.struct(F.lit(3).alias("a b")).alias("Removed_Lines"), F.lit(4).alias("group_id"), F.lit(5).alias("_taken_id"), F.lit(6).alias("sequence"), F.lit(7).alias("_len"))
    for name, f in P.STAGES:
        for frame in (docs, clash):
            assert f(spark, frame.limit(0), odd).collect() == []
        out = f(spark, clash, odd)
        rows = out.collect()
        assert rows
        if name == "packing":
            assert sum(x.length for x in rows) == docs.agg(F.sum(mixing.tokens(F.col("text")))).collect()[0][0]
            continue
        assert [c for c in out.columns if c != "Removed_Lines"] == [c for c in clash.columns if c != "Removed_Lines"]
        nulls = sum(x.doc_id is None for x in rows)
        ids = {x.doc_id for x in rows}
        assert all(x.group_id == 4 and x._quality == 2 for x in rows)
        if name == "quality":
            assert not {90001, 90002} & ids
        elif name == "line_dedup":
            assert {90001, 90002} <= ids and nulls == 1
        elif name == "near_dedup":
            assert {90001, 90002, 90005} <= ids and 90004 not in ids and nulls == 1
        elif name == "mixing":
            assert not {90001, 90002, 90005} & ids
