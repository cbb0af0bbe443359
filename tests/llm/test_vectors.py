import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import components, vector_graph
from lakeloom.llm.scratch import Scratch


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], f"vec_id int, embedding array<{kind}>")


def truth(x, least=0.95):
    u = np.asarray(x, float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def classes(near):
    out = np.arange(len(near))
    for i in range(len(near)):
        if out[i] == i:
            todo = [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if out[j] > i:
                        out[j] = i
                        todo.append(j)
    return out


def test_graph_recall_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 32))
    hot = x[0] + 0.1 * r.standard_normal((250, 32))
    few = x[1:41] + 0.1 * r.standard_normal((40, 32))
    x = np.concatenate([x, hot, few, x[100:110]])
    rows = [(i, [float(z) for z in v], 1) for i, v in enumerate(x)]
    nan = float("nan")
    odd = [(90000, None, 1), (90001, [], 1), (90002, [0.0] * 32, 1), (90003, [nan] * 32, 1), (90004, [1.0] * 5, 1), (90005, [None] * 32, 1), (None, rows[0][1], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id int, embedding array<double>, class_id int")
    near = truth(x)
    assert near.sum() > 20000
    got = {g.vec_id: g for g in vector_graph.similar_vectors(df, shard_rows=600).collect()}
    assert got.keys() == set(range(len(x)))
    links = np.array([got[i].links for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() / near.sum() >= 0.98
    assert np.mean([got[i].class_id for i in range(len(x))] == classes(near)) >= 0.99
    assert vector_graph.similar_vectors(df.limit(0)).collect() == []
    for p in vector_graph.point_pairs(df, shard_rows=600).collect():
        assert p.id_a < p.id_b and near[p.id_a, p.id_b]


def test_equal_and_almost_equal_vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((500, 64)).astype(np.float32).astype(float)
    near = base[1] + 0.01 * r.standard_normal(64)
    scaled = [np.float32(k * base[3]).astype(float) for k in r.uniform(0.1, 9, 300)]  # directions that differ in their last bits
    x = [*base, *[base[0]] * 59, *[base[1]] * 299, *[2 * base[2]] * 3, near, near, *scaled]
    want = truth(x)
    for shard_rows in (2000, 300):  # the smaller splits shards
        got = {g.vec_id: g for g in vector_graph.similar_vectors(frame(spark, x, "double"), shard_rows=shard_rows, attempts=1).collect()}
        assert [got[i].links for i in range(len(x))] == want.sum(1).tolist()
        assert [got[i].class_id for i in range(len(x))] == classes(want).tolist()


def test_pairs_that_share_no_shard_are_found(spark, monkeypatch):
    """Every vector in one shard and searched in it alone: what crosses comes over edges of the united graph."""
    r = np.random.default_rng(8)
    angles = np.sort(r.uniform(0, 2 * np.pi, 1500))
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    want = truth(x, 0.999)
    real = vector_graph._assign
    monkeypatch.setattr(vector_graph, "_assign", lambda cents, many: real(cents, 2 if many == 2 else 1))
    links = vector_graph.point_pairs(frame(spark, x, "double"), threshold=0.999, shard_rows=200, attempts=1, target=0.0).collect()
    got = {(p.id_a, p.id_b) for p in links}
    true = set(zip(*np.nonzero(np.triu(want)), strict=True))
    assert got <= true and len(got) / len(true) > 0.99


def test_low_dimensional_recall(spark):
    x = np.random.default_rng(5).standard_normal((4000, 8))
    want = truth(x)
    got = vector_graph.similar_vectors(frame(spark, x, "double"), shard_rows=100).collect()
    assert sum(g.links for g in got) / want.sum() >= 0.98


def test_audit_looks_until_links_are_seen_and_a_miss_is_an_error(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((700, 32)), np.zeros((20, 32))])
    x[700:] = x[0] + 0.01 * r.standard_normal((20, 32))
    df = frame(spark, x)
    clean = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    none = spark.createDataFrame([], "q int, id int")
    recall, seen = vector_graph.audit(clean, none, 0.95, queries=1)
    assert recall == 0 and 100 <= seen <= 420
    assert vector_graph.audit(clean.limit(3), none, 0.95) == (1.0, 0)
    monkeypatch.setattr(vector_graph, "audit", lambda *_: (0.5, 100))
    with pytest.raises(vector_graph.RecallTooLow, match="0.500 of 100"):
        vector_graph.similar_vectors(df, attempts=2)


def test_robust_rule():
    r = np.random.default_rng(2)
    x = vector_graph.unit(r.standard_normal((60, 8))).astype(np.float32)
    got = vector_graph.prune(x, np.arange(60), np.tile(np.arange(60), (60, 1)), 5)
    for p in range(60):
        d = np.linalg.norm(x - x[p], axis=1)
        left, want = [c for c in np.argsort(d, kind="stable") if c != p], []
        while left and len(want) < 5:
            c = left.pop(0)
            want.append(c)
            left = [y for y in left if vector_graph.ALPHA * np.linalg.norm(x[c] - x[y]) > d[y]]
        assert got[p][got[p] >= 0].tolist() == want


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.v: x.root for x in components.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint"), Scratch(spark, "t")).collect() == []
