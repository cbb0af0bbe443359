"""Embedding near-dedup over a robust-pruned flat graph.

Vectors of one direction are one point. Points go to the shards of their OVERLAP nearest centroids. Each shard builds a graph: a node's nearest and some random
members are pruned by the robust rule (a candidate goes if a kept neighbour is ALPHA times nearer to it than the node is), reverse edges are added
and pruned again. The adjacency lists of all shards are united.

Every point is searched from the medoids of its PROBES nearest shards: a greedy beam search over the united graph, whose results in range go on
expanding until no further neighbour is in range. Edges of what is in range that leave the shard are followed in rounds of joins until no round finds more: an edge is left out
only where the triangle inequality, from its length, rules its end out. Cosines are exact, so every reported link is verified. Recall is
audited against brute force on a sample of queries that grows until it has seen enough true links; a run below the target is repeated with
more overlap, probes and a wider beam, and if the last one misses it too, that is an error.

Points that differ in their last bits only (cosine of TIE and more) are one node of a shard's graph, since the robust rule would part them, and each is compared by itself.
Shards of more than twice shard_rows points, as of a hot cluster, are split, and their queries go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from .components import components
from .frames import kind, numbered, position
from .scratch import Scratch

DEGREE, LONG, NEAR, BEAM, ALPHA, TIE = 20, 8, 48, 32, 1.2, 1 - 1e-6
BLOCK = 256


class RecallTooLow(RuntimeError):
    """The audit missed its target in the last attempt too."""


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors; empty clusters keep their centroid."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """For each node up to most of its candidates (-1: none) by the robust rule, nearest first; padded with -1."""
    out = np.full((len(nodes), most), -1, np.int64)
    for b in range(0, len(nodes), BLOCK):
        n, c = nodes[b : b + BLOCK], cand[b : b + BLOCK]
        v = x[np.maximum(c, 0)]
        d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,ncd->nc", x[n], v)))
        d[(c < 0) | (c == n[:, None])] = np.inf
        order = np.argsort(d, 1, kind="stable")
        c, d, v = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
        alive, count = np.isfinite(d), np.zeros(len(n), np.int64)
        for j in range(c.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < most))
            if len(take):
                out[b + take, count[take]] = c[take, j]
                count[take] += 1
                alive[take] &= ALPHA * between[take, j] > d[take]
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Adjacency (n x DEGREE + LONG, padded with -1) of one shard's unit vectors, and its medoid."""
    n = len(x)
    r = np.random.default_rng(seed)
    medoid = int((x @ x.mean(0)).argmax())
    k = min(NEAR, n - 1)
    near = np.full((n, max(1, k)), -1, np.int64)
    for b in range(0, n, 1024):
        s = x[b : b + 1024] @ x.T
        s[np.arange(len(s)), np.arange(b, b + len(s))] = -2
        if k:
            near[b : b + 1024] = np.argpartition(-s, k - 1, 1)[:, :k]
    far = np.concatenate([r.integers(0, n, (n, 4 * LONG)), np.full((n, 1), medoid)], 1)
    nodes = np.arange(n)
    adj = np.concatenate([prune(x, nodes, near, DEGREE), prune(x, nodes, far, LONG)], 1)
    # reverse edges, pruned to the same degree; the medoid reaches out to the far candidates as well
    src, dst = np.repeat(nodes, adj.shape[1]), adj.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, np.arange(n + 1))
    at = np.arange(len(dst)) - first[dst]
    wide = 3 * DEGREE
    back = np.full((n, wide), -1, np.int64)
    ok = at < wide
    back[dst[ok], at[ok]] = src[ok]
    every = np.concatenate([adj, back], 1)
    every = np.sort(every, 1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    near = prune(x, nodes, every, DEGREE)
    for hub in np.unique(dst[~ok]):  # longer lists one by one
        near[hub] = prune(x, np.array([hub]), np.unique(np.concatenate([adj[hub][adj[hub] >= 0], src[first[hub] : first[hub + 1]]]))[None], DEGREE)[0]
    return np.concatenate([near, adj[:, DEGREE:]], 1), medoid


def ties(x: np.ndarray) -> np.ndarray:
    """For each vector the first one before it, that is its own, whose cosine with it is at least TIE; else itself."""
    out = np.arange(len(x))
    for b in range(0, len(x), 1024):
        s = x[b : b + 1024] @ x[: b + 1024].T >= TIE
        for i in np.flatnonzero(np.tril(s, b - 1).any(1)):
            js = np.flatnonzero(s[i, : b + i])
            js = js[out[js] == js]
            if len(js):
                out[b + i] = js[0]
    return out


def search(x: np.ndarray, adj: np.ndarray, medoid: int, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) at or above least."""
    n, out = len(x), ([], [], [])
    for b in range(0, len(queries), BLOCK):
        q = queries[b : b + BLOCK]
        m = len(q)
        rows = np.arange(m)
        seen = np.zeros((m, n), bool)
        hits = np.zeros((m, n), bool)
        opened = np.zeros((m, n), bool)
        sims = np.full((m, n), -2, np.float32)

        def look(r: np.ndarray, c: np.ndarray) -> None:
            for s in range(0, len(r), 1 << 16):
                rr, cc = r[s : s + (1 << 16)], c[s : s + (1 << 16)]
                v = np.einsum("nd,nd->n", q[rr], x[cc])  # noqa: B023
                sims[rr, cc] = v  # noqa: B023
                hits[rr, cc] = v >= least  # noqa: B023
            seen[r, c] = True  # noqa: B023

        look(rows, np.full(m, medoid))
        top = np.full((m, beam), -1, np.int64)
        top[:, 0] = medoid
        while True:
            shut = (top < 0) | opened[rows[:, None], np.maximum(top, 0)]
            score = np.where(shut, -3, sims[rows[:, None], np.maximum(top, 0)])
            best = score.argmax(1)
            go = np.flatnonzero(score[rows, best] > -3)
            if not len(go):
                break
            node = top[go, best[go]]
            opened[go, node] = True
            nb = adj[node]
            new = (nb >= 0) & ~seen[go[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(new)
            if len(r):
                look(go[r], nb[r, c])
            cand = np.concatenate([top[go], np.where(new, nb, -1)], 1)
            # an adjacency list may name a node twice after the union
            value = np.where(cand < 0, -3, sims[go[:, None], np.maximum(cand, 0)])
            keep = np.argpartition(-value, beam - 1, 1)[:, :beam]
            top[go] = np.take_along_axis(cand, keep, 1)
        while True:  # the range grows from what is in range
            r, node = np.nonzero(hits & ~opened)
            if not len(r):
                break
            opened[r, node] = True
            for s in range(0, len(r), 1 << 15):
                nb = adj[node[s : s + (1 << 15)]]
                rr = np.repeat(r[s : s + (1 << 15)], nb.shape[1])
                cc = nb.ravel()
                ok = cc >= 0
                ok[ok] = ~seen[rr[ok], cc[ok]]
                if ok.any():
                    pair = np.unique(rr[ok] * n + cc[ok])
                    look(pair // n, pair % n)
        r, c = np.nonzero(hits)
        out[0].append(r + b)
        out[1].append(c)
        out[2].append(sims[r, c])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def _matrix(col) -> np.ndarray:
    return unit(np.stack([np.asarray(v, np.float64) for v in col])).astype(np.float32)


def _assign(cents: np.ndarray, many: int):
    """A row for each of a vector's many nearest shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist())
            s = x @ cents.T
            k = min(many, s.shape[1])
            near = np.argpartition(-s, k - 1, 1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(x), 1))
            take = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["shard", "id", "v"])

    return run


def _builder(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one part of a shard over the firsts of its ties; every other one has an edge to its first."""
    pdf = pdf.sort_values("id", ignore_index=True)
    ids, x = pdf["id"].to_numpy(), _matrix(pdf["v"])
    rep = ties(x)
    firsts = np.flatnonzero(rep == np.arange(len(x)))
    adj, _ = build(x[firsts])
    near = {int(f): firsts[row[row >= 0]] for f, row in zip(firsts, adj, strict=True)}
    lists = [near.get(i, rep[i : i + 1]) for i in range(len(x))]
    return pd.DataFrame({"id": ids, "near": [ids[r] for r in lists], "cos": [x[r] @ x[i] for i, r in enumerate(lists)]})


def _searcher(least: float, beam: int):
    """One part of a shard and some of its queries -> (q, id, cosine) in range, and with no cosine (q, id) to look at elsewhere."""
    theta, slack = np.arccos(least), np.arccos(TIE) + 1e-4

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"q": queries["id"].iloc[:0], "id": queries["id"].iloc[:0], "cosine": np.zeros(0)})
        index = index.sort_values("id", ignore_index=True)
        ids, x = index["id"].to_numpy(), _matrix(index["v"])
        rep = ties(x)
        firsts = np.flatnonzero(rep == np.arange(len(x)))
        row_of = np.full(len(x), -1)
        row_of[firsts] = np.arange(len(firsts))
        row_of = row_of[rep]
        members = np.argsort(row_of, kind="stable")
        begin = np.searchsorted(row_of[members], np.arange(len(firsts) + 1))
        lens = index["near"].map(len).to_numpy()
        flat = np.concatenate(index["near"].tolist())
        cosines = np.concatenate(index["cos"].tolist())
        src = np.repeat(np.arange(len(ids)), lens)
        place = pd.Index(ids).get_indexer(flat)
        local = place >= 0
        edges = np.unique(np.stack([row_of[src[local]], row_of[place[local]]], 1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        first = np.searchsorted(edges[:, 0], np.arange(len(firsts) + 1))
        adj = np.full((len(firsts), max(1, int(np.diff(first).max()))), -1, np.int64)
        adj[edges[:, 0], np.arange(len(edges)) - first[edges[:, 0]]] = edges[:, 1]
        medoid = int((x[firsts] @ x.mean(0)).argmax())
        qids, qx = queries["id"].to_numpy(), _matrix(queries["v"])
        a, b, _ = search(x[firsts], adj, medoid, qx, float(np.cos(min(np.pi, theta + slack))), beam)
        many = begin[b + 1] - begin[b]
        a, start = np.repeat(a, many), np.repeat(begin[b], many)
        c = members[start + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)]
        s = np.concatenate([np.einsum("nd,nd->n", qx[a[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, np.float32)
        ok = (s >= least) & (qids[a] != ids[c])
        hit_q, hit_c, hit_s = a[ok], c[ok], s[ok]
        # edges out of the shard, of what is in range (a query is in range of itself)
        away = np.flatnonzero(~local & (cosines >= np.cos(min(np.pi, 2 * theta)) - 1e-4))
        out_q, out_id = [], []
        if len(away):
            own = pd.Index(ids).get_indexer(qids)
            there = np.flatnonzero(own >= 0)
            q2, c2, s2 = np.concatenate([hit_q, there]), np.concatenate([hit_c, own[there]]), np.concatenate([hit_s, np.ones(len(there), np.float32)])
            lo, hi = np.searchsorted(src[away], c2), np.searchsorted(src[away], c2, "right")
            for q, s, i, j in zip(q2, s2, lo, hi, strict=True):
                if i < j:
                    far = away[i:j][cosines[away[i:j]] >= np.cos(min(np.pi, theta + np.arccos(min(1.0, s)))) - 1e-4]
                    out_q += [qids[q]] * len(far)
                    out_id += flat[far].tolist()
        q, i = np.concatenate([qids[hit_q], np.array(out_q, qids.dtype)]), np.concatenate([ids[hit_c], np.array(out_id, ids.dtype)])
        return pd.DataFrame({"q": q, "id": i, "cosine": np.concatenate([hit_s.astype(float), np.full(len(out_q), np.nan)])}).drop_duplicates(["q", "id"])

    return run


def _directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1).to_pylist())
            offs = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(x.ravel()))], ["id", "v"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = np.einsum("nd,nd->n", _matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s.astype(np.float64))], ["q", "id", "cosine"])


def _brute(queries: np.ndarray, qids: list, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = _matrix(batch.column(1).to_pylist()) @ queries.T
            r, c = np.nonzero(s >= least)
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in c], batch.schema.field(0).type), batch.column(0).take(pa.array(r))], ["q", "id"])

    return run


def audit(clean: DataFrame, links: DataFrame, least: float, queries: int = 64, enough: int = 100, most: int = 4096) -> tuple[float, int]:
    """Share of the true links (q, id) of a sample of queries (the first by hash of the id) that links has, and their number.

    The sample grows from queries to most until enough true links are seen. Where there are none, nothing can be missed: 1.0.
    """
    id_type = kind(clean, "id")
    while True:
        sample = clean.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
        if not sample:
            return 1.0, 0
        qids = [r[0] for r in sample]
        true = clean.mapInArrow(_brute(_matrix([r[1] for r in sample]), qids, least + 1e-6), StructType([StructField("q", id_type), StructField("id", id_type)])).filter("q <> id")
        row = true.join(links.select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left").agg(F.count("*"), F.count("hit")).collect()[0]
        if row[0] >= enough or len(sample) < queries or queries >= most:
            return (row[1] / row[0] if row[0] else 1.0), row[0]
        queries = min(most, queries * 8)


def _search_all(clean: DataFrame, cents: np.ndarray, overlap: int, probes: int, beam: int, threshold: float, shard_rows: int, scratch: Scratch, tag: str) -> DataFrame:
    """(q, id, cosine) of points in range of each other, both ways."""
    id_type = kind(clean, "id")
    vec = ArrayType(FloatType())
    rows = StructType([StructField("shard", IntegerType()), StructField("id", id_type), StructField("v", vec)])
    # as many rows as there are shards
    index = clean.mapInArrow(_assign(cents, overlap), rows)
    asked = clean.mapInArrow(_assign(cents, probes), rows)
    size = index.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_rows)).cast("int").alias("parts"))
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / (8 * shard_rows)).cast("int").alias("turns"))
    plan = scratch.keep(size.join(load, "shard"), f"plan{tag}")
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = scratch.keep(index.join(plan, "shard").select("shard", spread("id", "parts").alias("part"), "turns", "id", "v"), f"index{tag}")
    lists = index.groupBy("shard", "part").applyInPandas(_builder, StructType([StructField("id", id_type), StructField("near", ArrayType(id_type)), StructField("cos", vec)]))
    edges = lists.select("id", F.explode(F.arrays_zip("near", "cos")).alias("e")).select("id", "e.near", "e.cos")
    union = scratch.keep(edges.groupBy("id", "near").agg(F.max("cos").alias("cos")).groupBy("id").agg(F.collect_list(F.struct("near", "cos")).alias("e")).select("id", F.col("e.near").alias("near"), F.col("e.cos").alias("cos")), f"graph{tag}")
    key = ["shard", "part", "turn"]
    left = index.join(union, "id").withColumn("turn", every("turns")).groupBy(*key)
    right = asked.join(plan, "shard").withColumn("turn", spread("id", "turns")).withColumn("part", every("parts")).groupBy(*key)
    out = StructType([StructField("q", id_type), StructField("id", id_type), StructField("cosine", DoubleType())])
    got = scratch.keep(left.cogroup(right).applyInPandas(_searcher(threshold, beam), out), f"found{tag}")
    hit = F.col("cosine").isNotNull() & ~F.isnan("cosine")
    found = scratch.keep(got.filter(hit).groupBy("q", "id").agg(F.max("cosine").alias("cosine")), f"hits{tag}")
    known, ask, r = found.select("q", "id"), got.filter(~hit).select("q", "id").filter("q <> id").distinct(), 0
    while True:
        ask = scratch.keep(ask.join(known, ["q", "id"], "left_anti"), f"ask{tag}_{r}")
        if ask.isEmpty():
            return found
        known = known.unionByName(ask)
        far = ask.join(clean.select(F.col("id").alias("q"), F.col("v").alias("a")), "q").join(clean.select("id", F.col("v").alias("b")), "id").select("q", "id", "a", "b")
        new = scratch.keep(far.mapInArrow(_cosines, out).filter(F.col("cosine") >= threshold), f"new{tag}_{r}")
        found = found.unionByName(new)
        # lossless: what lies in range of q lies within both angles of id
        reach = F.cos(F.acos(F.lit(threshold)) + F.acos(F.least("cosine", F.lit(1.0)))) - 1e-4
        ask = new.join(union, "id").select("q", F.explode(F.arrays_zip("near", "cos")).alias("e"), reach.alias("reach")).filter(F.col("e.cos") >= F.col("reach")).select("q", F.col("e.near").alias("id")).filter("q <> id").distinct()
        r += 1


def _linked_points(df: DataFrame, id_col: str, vec_col: str, threshold: float, shard_rows: int, overlap: int, sample_rows: int, target: float, attempts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(id, point, k) of every vector, point being the least id of its direction and k the vectors of it; (q, id, cosine) of points. None: no vectors."""
    spark, id_type = df.sparkSession, kind(df, id_col)
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)) & F.exists(v, lambda x: F.abs(x) > 1e-18)
    plain = numbered(df)
    rows = plain.select(F.col(f"c{position(df, id_col)}").alias("id"), F.col(f"c{position(df, vec_col)}").cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & good)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    if not dims:
        return None
    single = rows.filter(F.size("v") == dims[0][0]).groupBy("id").agg(F.min("v").alias("v"))
    every = scratch.keep(single.mapInArrow(_directions, StructType([StructField("id", id_type), StructField("v", ArrayType(FloatType()))])).withColumn("h", F.xxhash64("v")), "every")
    points = scratch.keep(every.groupBy("h", "v").agg(F.min("id").alias("point"), F.count("*").alias("k")), "points")
    members = scratch.keep(every.join(points, ["h", "v"]).select("id", "point", "k"), "members")
    clean = points.select(F.col("point").alias("id"), "v")
    n = points.count()
    fit = _matrix([r[0] for r in clean.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()])
    recall, seen = 0.0, 0
    for attempt in range(attempts):
        wide = overlap + attempt
        cents = kmeans(fit, max(1, -(-n * wide // shard_rows)))
        links = _search_all(clean, cents, wide, (wide + 1) * 2**attempt, BEAM * (attempt + 1), threshold, shard_rows, scratch, str(attempt))
        back = links.select(F.col("id").alias("q"), F.col("q").alias("id"), "cosine")
        links = scratch.keep(links.unionByName(back).groupBy("q", "id").agg(F.max("cosine").alias("cosine")), f"links{attempt}")
        recall, seen = audit(clean, links, threshold)
        if recall >= target:
            return members, links
    raise RecallTooLow(f"audited recall {recall:.3f} of {seen} true links after {attempts} attempts; the target is {target}")


Options = {"shard_rows": 2000, "overlap": 2, "sample_rows": 20_000, "target": 0.95, "attempts": 4}


def point_pairs(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, **options) -> DataFrame:
    """(id_a, id_b, cosine): id_a < id_b, pairs of points, by the least id of each, whose cosine is at least threshold. Rules as in similar_vectors."""
    scratch = Scratch(df.sparkSession, "graph")
    got = _linked_points(df, id_col, vec_col, threshold, **(Options | options), scratch=scratch)
    if got is None:
        return df.sparkSession.createDataFrame([], StructType([StructField("id_a", kind(df, id_col)), StructField("id_b", kind(df, id_col)), StructField("cosine", DoubleType())]))
    return got[1].filter("q < id").select(F.col("q").alias("id_a"), F.col("id").alias("id_b"), "cosine")


def similar_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, **options) -> DataFrame:
    """(id_col, class_id, links) of every vector: the least id of its near copies, through any chain of links, and how many other vectors have a cosine of threshold or more with it.

    Every vector is a query. Rows with a null id, and vectors that are null, empty, zero, of another length than most, or have
    null or non-finite parts, are not in the result. Rows that share an id count as one, the least vector. Equal vectors, and multiples, are linked with each other. Ties in cosine
    don't matter: all that reach the threshold count. Other columns are not read. An empty table gives an empty result. An audit that misses its target in
    the last attempt raises RecallTooLow. options: shard_rows, overlap, sample_rows (vectors that the centroids are fitted on; all are indexed), target, attempts.
    """
    scratch = Scratch(df.sparkSession, "graph")
    got = _linked_points(df, id_col, vec_col, threshold, **(Options | options), scratch=scratch)
    if got is None:
        t = kind(df, id_col)
        return df.sparkSession.createDataFrame([], f"`{id_col}` {t.simpleString()}, class_id {t.simpleString()}, links bigint")
    members, links = got
    roots = components(links.filter("q < id").select(F.col("id").alias("u"), F.col("q").alias("v")), scratch).select(F.col("v").alias("point"), "root")
    weights = members.filter("id = point").select(F.col("point").alias("id"), "k")
    degree = links.join(weights, "id").groupBy(F.col("q").alias("point")).agg(F.sum("k").alias("others"))
    out = members.join(roots, "point", "left").join(degree, "point", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "point").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("k") - 1).cast("bigint").alias("links"))
