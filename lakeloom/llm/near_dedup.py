"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its runs of SHINGLE words, and its sketch one byte of each of SKETCH minhashes; two
documents are near copies if at least the threshold's share of the bytes agree (Hamming distance, a metric). In each of several
independent trees a document goes down to the children named by a few chosen minhashes: 1/threshold of them on
average, chosen by a hash of the path, and none that the path has used before. Nodes of at most SMALL documents are compared exhaustively; others branch
again, until they are small or every minhash has been used. Trees are added until the recall, measured against brute force for a sample of documents, reaches the target.

Documents with one and the same multiset of shingles are one point of the search. In a node too large to compare, near copies
of a frequent document (a leader) would go down together for ever. They leave the tree there: everything within RADIUS
of a leader is linked to it. By the triangle inequality such a document x can have partners only within limit + RADIUS of the leader;
those within the limit are linked to the leader itself, and those beyond it (the rim) are compared with every x in a
node of their own, until one of them links it: x are linked with each other by the leader. So groups stay exact whatever their size.
Nodes of more than HOT rows are split among tasks, all of which get the same rows to choose leaders from, and the same rim.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, LongType, StructField, StructType

from . import bytes_kernel as K
from .components import components
from .frames import ids_and_texts, kind, position
from .scratch import Scratch

SHINGLE, SKETCH, SMALL, HOT = 2, 128, 128, 50_000
_r = np.random.default_rng(2018)
MULT = _r.integers(1, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _r.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)


def _mix(x: int) -> int:
    x &= 2**64 - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def chosen(path: int, threshold: float, used: int = 0) -> list[int]:
    """The minhashes by which a node branches: 1/threshold of them on average, none twice and none of used (a set of bits).

    Fewer where fewer are left, and none where all have been used.
    """
    x = _mix(path ^ 0x5851F42D4C957F2D)
    many = int(1 / threshold) + ((x >> 11) / 2**53 < 1 / threshold - int(1 / threshold))
    free = [p for p in range(SKETCH) if not used >> p & 1]
    out: list[int] = []
    while free and len(out) < many:
        x = _mix(x + 0x9E3779B97F4A7C15)
        out.append(free.pop(x % len(free)))
    return out


def signatures(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with any word, two 64-bit hashes of their shingles as a multiset, and their minhashes (uint32)."""
    h, doc, first = K.words(data, offs)
    s, d = K.shingles(h, doc, first, SHINGLE)
    rows, begin = np.unique(d, return_index=True)
    if not len(rows):
        return rows, np.zeros((0, 2), np.int64), np.zeros((0, SKETCH), np.uint32)
    sums = np.stack([np.add.reduceat(K.mix(s ^ K.U(k)), begin) for k in (0x1234567, 0x7654321)], 1)
    x = (s >> K.U(32)).astype(np.uint32)
    mins = np.empty((len(rows), SKETCH), np.uint32)
    for k in range(SKETCH):
        mins[:, k] = np.minimum.reduceat(x * MULT[k] + ADD[k], begin)
    return rows, sums.view(np.int64), mins


def _roots(trees: range, threshold: float) -> list[tuple[int, int]]:
    return [(t, p) for t in trees for p in chosen(t, threshold)]


def _sketch(trees: range, threshold: float):
    """id, two hashes of the shingles, sketch, and the node that the document goes to by each of the trees' first minhashes."""
    roots = _roots(trees, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.array([_mix(t * SKETCH + p + 1) for t, p in roots], np.uint64)
        at = np.array([p for _, p in roots])
        for batch in batches:
            ids = batch.column(0)
            data, offs = K.flat(batch.column(1))
            for i, _, d, o in K.blocks(data, offs):
                rows, sums, mins = signatures(d, o)
                low = K.mix(mins.astype(np.uint64) + K.U(1)).astype(np.uint8)  # a byte of a minhash
                nodes = K.mix(mins[:, at].astype(np.uint64) ^ salt).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + i)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([r.tobytes() for r in low], pa.binary()), pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, len(roots), dtype=np.int32), nodes.ravel())],
                    ["id", "a", "b", "sketch", "nodes"],
                )

    return run


def star(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """(low, high) edges that join what a symmetric matrix of hits joins; indexes are in order."""
    n = len(hit)
    done = np.zeros(n, bool)
    for i in np.flatnonzero(hit.sum(1) > 1):
        if done[i]:
            continue
        done[i] = True
        todo = [i]
        while todo:
            j = todo.pop()
            new = np.flatnonzero(hit[j] & ~done)
            done[new] = True
            todo += new.tolist()
            yield from ((int(i), int(x)) for x in new)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that agree, for every pair of rows."""
    out = np.empty((len(x), len(y)), np.int16)
    step = max(1, (1 << 22) // max(1, len(y) * SKETCH))
    for i in range(0, len(x), step):
        out[i : i + step] = (x[i : i + step, None, :] == y[None, :, :]).sum(2, dtype=np.int16)
    return out


#: What a row is in its node, in the order in which a task reads them.
LEAD, RIM, MEMBER, PLAIN = 0, 1, 2, 3
COLUMNS = ["node", "used", "role", "x", "y", "sketch"]


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)


def _level(threshold: float):
    """Nodes in order of (node, role, x) -> edges (node null, x, y) and rows of the next level (node, used, role, x, sketch)."""
    least = int(np.ceil(threshold * SKETCH))
    radius = (SKETCH - least) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [], [])

        def emit(node, used, role, x, y, sketch):
            for col, v in zip(out, (node, used, role, x, y, sketch), strict=True):
                col.append(v)

        def edge(x, y):
            if x != y:
                emit(None, None, None, *sorted((x, y)), None)

        def flush(force=False):
            if len(out[0]) >= 20000 or (force and out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int8()), pa.array(out[3], id_type), pa.array(out[4], id_type), pa.array(out[5], pa.binary())], COLUMNS)
                for col in out:
                    col.clear()

        def compare(ids, sk):
            for i, j in star(agreeing(sk, sk) >= least):
                edge(ids[i], ids[j])

        class Large:
            """A node too large to compare at once: its leaders come from its first rows."""

            def __init__(self, node, used, ids, sk):
                bits = int.from_bytes(used, "little")
                self.picks = chosen(node, threshold, bits)
                self.used = [(bits | 1 << p).to_bytes(SKETCH // 8, "little") for p in self.picks]
                self.salt = np.array([_mix(node ^ (p + 1) * 0xA0761D6478BD642F) for p in self.picks], np.uint64)
                close = agreeing(sk, sk) >= SKETCH - radius
                free = np.ones(len(ids), bool)
                self.lead: list[int] = []
                for i in np.argsort(-close.sum(1), kind="stable"):
                    if free[i] and (close[i] & free).sum() >= 4:
                        self.lead.append(int(i))
                        free &= ~close[i]
                self.lead_ids = [ids[i] for i in self.lead]
                self.lead_sk = sk[self.lead]
                self.keys = [int(np.int64(np.uint64(_mix(node ^ hash_id(x))))) for x in self.lead_ids]
                self.first = ids[0], sk[:1]

            def take(self, ids, sk):
                gone = np.zeros(len(ids), bool)
                if len(self.lead):
                    m = agreeing(sk, self.lead_sk)
                    for k, lead in enumerate(self.lead_ids):
                        for i in np.flatnonzero(~gone & (m[:, k] >= least - radius)):
                            if ids[i] == lead:
                                continue
                            if m[i, k] >= least:
                                edge(lead, ids[i])
                            if m[i, k] >= SKETCH - radius:
                                if ids[i] not in self.lead_ids:
                                    gone[i] = True
                                    emit(self.keys[k], None, MEMBER, ids[i], None, sk[i].tobytes())
                            elif m[i, k] < least:
                                emit(self.keys[k], None, RIM, ids[i], None, sk[i].tobytes())
                stay = np.flatnonzero(~gone)
                if not self.picks:  # every minhash has been used: what is here agrees in all of them
                    same = agreeing(sk[stay], self.first[1])[:, 0] >= least
                    for i in stay[same]:
                        edge(self.first[0], ids[i])
                for p, used, salt in zip(self.picks, self.used, self.salt, strict=True):
                    child = K.mix((sk[stay, p].astype(np.uint64) + K.U(1)) * K.U(0x9FB21C651E98DF25) ^ salt).view(np.int64)
                    for i, c in zip(stay, child.tolist(), strict=True):
                        emit(c, used, PLAIN, ids[i], None, sk[i].tobytes())

        def hash_id(x):
            return int.from_bytes(repr(x).encode()[-8:].rjust(8, b"0"), "big")

        key, used, ids, sks, large, lead, rim, rim_sk, members = None, None, [], [], None, [], [], None, []

        def close_rim():
            """Rim rows that agree with any of the members: one link each says all."""
            nonlocal rim, rim_sk
            if rim and members:
                rim_sk = _matrix([s for _, s in rim]) if rim_sk is None else rim_sk
                hit = agreeing(_matrix([s for _, s in members]), rim_sk) >= least
                for k in np.flatnonzero(hit.any(0)):
                    edge(members[int(hit[:, k].argmax())][0], rim[k][0])
                left = np.flatnonzero(~hit.any(0))
                rim, rim_sk = [rim[k] for k in left], rim_sk[left]
            members.clear()

        def finish():
            close_rim()
            if large is not None and ids:
                large.take(ids, _matrix(sks))
            elif len(ids) > 1:
                compare(ids, _matrix(sks))

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("x").type
            for nd, part, us, role, x, sk in zip(*(batch.column(c).to_pylist() for c in ("node", "part", "used", "role", "x", "sketch")), strict=True):
                if (nd, part) != key:
                    if key is not None:
                        finish()
                    key, used, ids, sks, large, lead, rim, rim_sk = (nd, part), us, [], [], None, [], [], None
                if role == RIM:
                    rim.append((x, sk))
                elif role == MEMBER:
                    members.append((x, sk))
                    if len(members) >= 256:
                        close_rim()
                elif role == LEAD:
                    if not lead or lead[-1][0] != x:
                        lead.append((x, sk))
                else:
                    if ids and ids[-1] == x:
                        continue
                    if lead and large is None:
                        large = Large(nd, us, [i for i, _ in lead], _matrix([s for _, s in lead]))
                    ids.append(x)
                    sks.append(sk)
                    if large is None and len(ids) > SMALL:
                        large = Large(nd, us, ids, _matrix(sks))
                    if large is not None and len(ids) >= SMALL:
                        large.take(ids, _matrix(sks))
                        ids, sks = [], []
            yield from flush()
        if key is not None:
            finish()
        yield from flush(True)

    return run


def _split_hot(level: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """level with part: nodes of more than HOT rows are spread; all their parts get the rim, and the same sample to find leaders in.

    What is hot is estimated from the documents of one in rate hashes: how a node is spread changes no link but by the leaders' sample.
    """
    names = ["node", "part", "used", "role", "x", "sketch"]
    rate = max(1, HOT // 500)
    some = level.filter(F.pmod(F.xxhash64(F.xxhash64("x")), F.lit(rate)) == 0).groupBy("node").count().select("node", (F.col("count") * rate).alias("count"))
    hot = some.filter(F.col("count") > HOT).select(F.col("node").alias("_node"), F.ceil(F.col("count") / HOT).cast("int").alias("_parts"), (F.lit(4.0 * SMALL) / F.col("count")).alias("_share"))
    hot = scratch.keep(hot, name)
    many = hot.count()
    if not many:
        return level.withColumn("part", F.lit(0)).select(*names)
    if many <= 100_000:  # 2 MB
        hot = F.broadcast(hot)
    rows = level.join(hot, F.col("node") == F.col("_node"), "left").withColumn("_u", F.xxhash64("x"))
    every = F.sequence(F.lit(0), F.col("_parts") - 1)
    mine = F.array(F.coalesce(F.pmod("_u", F.col("_parts")), F.lit(0)).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when((F.col("role") == RIM) & F.col("_parts").isNotNull(), every).otherwise(mine)))
    picked = (F.col("role") == PLAIN) & F.col("_parts").isNotNull() & (F.pmod(F.xxhash64("_u"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    lead = level.join(hot, F.col("node") == F.col("_node")).withColumn("_u", F.xxhash64("x")).filter(picked).withColumn("role", F.lit(LEAD).cast("tinyint")).withColumn("part", F.explode(every))
    return rows.select(*names).unionByName(lead.select(*names))


def _edges(points: DataFrame, scratch: Scratch, threshold: float, trees: range, id_type) -> DataFrame:
    """(u, v): links that the trees find. points: (x, sketch, nodes)."""
    bits = [(1 << p).to_bytes(SKETCH // 8, "little") for _, p in _roots(trees, threshold)]
    used = F.array(*[F.lit(bytearray(b)) for b in bits])
    level = points.select("x", "sketch", F.explode(F.arrays_zip(F.col("nodes").alias("node"), used.alias("used"))).alias("z"))
    level = level.select(F.col("z.node").alias("node"), F.col("z.used").alias("used"), F.lit(PLAIN).cast("tinyint").alias("role"), "x", "sketch")
    schema = StructType([StructField("node", LongType()), StructField("used", BinaryType()), StructField("role", ByteType()), StructField("x", id_type), StructField("y", id_type), StructField("sketch", BinaryType())])
    found, depth = None, 0
    while True:
        depth += 1
        ordered = _split_hot(level, scratch, f"tree{trees.start}hot{depth}").repartition("node", "part").sortWithinPartitions("node", "part", "role", "x")
        done = scratch.keep(ordered.mapInArrow(_level(threshold), schema), f"tree{trees.start}level{depth}")
        edges = done.filter("node is null").select(F.col("x").alias("u"), F.col("y").alias("v"))
        found = edges if found is None else found.unionByName(edges)
        level = done.filter("node is not null").select("node", "used", "role", "x", "sketch")
        if level.isEmpty():
            return found


def _true_pairs(queries: np.ndarray, qids: list, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r, c = np.nonzero(agreeing(_matrix(batch.column(1).to_pylist()), queries) >= least)
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in c], batch.schema.field(0).type), batch.column(0).take(pa.array(r))], ["q", "x"])

    return run


def measured_recall(points: DataFrame, roots: DataFrame, threshold: float, queries: int = 128, enough: int = 100, most: int = 2048) -> tuple[float, int]:
    """Share of the near pairs of a sample of points (the first by hash) whose two ends are in one group, and how many pairs that is.

    All points are compared with the sample, which grows from queries to most until enough pairs are seen. No pair: 1.0.
    """
    id_type = kind(points, "x")
    while True:
        sample = points.select("x", "sketch").orderBy(F.xxhash64("x"), "x").limit(queries).collect()
        if not sample:
            return 1.0, 0
        true = points.select("x", "sketch").mapInArrow(_true_pairs(_matrix([bytes(r[1]) for r in sample]), [r[0] for r in sample], int(np.ceil(threshold * SKETCH))), StructType([StructField("q", id_type), StructField("x", id_type)])).filter("q <> x")
        of = lambda c: roots.select(F.col("x").alias(c), F.col("root").alias(f"{c}_root"))
        joined = true.join(of("q"), "q", "left").join(of("x"), "x", "left")
        row = joined.agg(F.count("*"), F.count_if(F.coalesce("q_root", "q") == F.coalesce("x_root", "x"))).collect()[0]
        if row[0] >= enough or len(sample) < queries or queries >= most:
            return (row[1] / row[0] if row[0] else 1.0), row[0]
        queries = min(most, queries * 4)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, trees: int = 6, target: float = 0.98, most_trees: int = 48) -> DataFrame:
    """(id_col, group_id, n): a row for each document that has a near copy, with the least id of its group and the group's size.

    Groups are connected components. Independent trees, trees at a time, are added until the measured recall is at least target; where most_trees
    don't reach it, a warning names the recall. Documents without any word (null, empty or only punctuation) and rows with a null id are in no
    group. Rows that repeat one id count once; if their texts differ, the id belongs to the group of each and is listed in the least. A document of fewer than
    SHINGLE words is the set of the one run of its words, so it pairs only with copies. Texts of any length are read whole. Ties don't matter: links are
    symmetric. Other columns are not read. An empty table gives no groups.
    """
    scratch = Scratch(df.sparkSession, "near")
    id_type = kind(df, id_col)
    src = ids_and_texts(df, id_col, text_col)
    schema = StructType([StructField("id", id_type), StructField("a", LongType()), StructField("b", LongType()), StructField("sketch", BinaryType()), StructField("nodes", ArrayType(LongType()))])
    members, points, found, start, name = None, None, None, 0, "cc"
    while True:
        batch = range(start, start + trees)
        sketched = scratch.keep(src.mapInArrow(_sketch(batch, threshold), schema), f"sketches{start}")
        now = scratch.keep(sketched.groupBy("a", "b").agg(F.min(F.struct("id", "sketch", "nodes")).alias("p")).select("a", "b", F.col("p.id").alias("x"), F.col("p.sketch").alias("sketch"), F.col("p.nodes").alias("nodes")), f"points{start}")
        if members is None:
            points = now
            members = sketched.select("id", "a", "b").join(points.select("a", "b", "x"), ["a", "b"]).select("id", "x").distinct()
        edges = _edges(now, scratch, threshold, batch, id_type)
        found = edges if found is None else found.unionByName(edges)
        start += trees
        roots = components(found, scratch, f"{name}{start}").select(F.col("v").alias("x"), "root")
        recall, seen = measured_recall(points, roots, threshold)
        if recall >= target:
            break
        if start >= most_trees:
            warnings.warn(f"near_groups: {start} trees reach a recall of {recall:.3f} over {seen} pairs; the target is {target}", stacklevel=2)
            break
    grouped = members.join(roots, "x", "left").groupBy("id").agg(F.min(F.coalesce("root", "x")).alias("group_id"))
    grouped = scratch.keep(grouped, "grouped")
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1")
    return grouped.join(sizes, "group_id").select(F.col("id").alias(id_col), "group_id", "n")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """df without the documents of each group but the one of the least id. Every row of a kept id stays, rows of a null id and of texts without words too."""
    gone = near_groups(df, id_col, text_col, **kw).toDF("_id", "_group", "_n").filter("_id <> _group").select("_id")
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.join(gone, F.col(f"c{position(df, id_col)}") == F.col("_id"), "left_anti").toDF(*names)
