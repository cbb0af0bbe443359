"""Substring dedup by content-defined chunks.

A gear hash over 16 bytes ends a chunk where it is below CUT and no other such place lies in the MIN_CHUNK bytes
before: both depend on nearby bytes only, so chunks fall in step again right after an insertion. No chunk but a whole
document is shorter than MIN_CHUNK. Chunks are compared by a 128-bit BLAKE2b digest; an occurrence other than the first, in order
of (id, start), is a repeat. Runs of adjoining repeats of MIN_RUN bytes or more, and documents that are a repeat as a whole, are removed.

Passes: (1) a 64-bit hash of each chunk, counted; (2) digests of the chunks that may repeat, by a bitmap of the first pass; (3) the documents, cut.
A chunk that occurs everywhere is one row of each task after partial aggregation, and its occurrences meet its first one in a
join that splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import bytes_kernel as K
from .frames import carry, ids_and_texts, kind
from .repeats import maybe, repeated

CUT = 65536 // 20
MIN_CHUNK = 16
MAX_CHUNK = 1024
#: Some 25 tokens of a public tokenizer. Shorter repeats are phrases and license lines that independent documents share.
MIN_RUN = 100


def chunk_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk of a block; chunks cover every byte and never split a character.

    Chunks longer than MAX_CHUNK, where no hash falls below CUT, are cut every MAX_CHUNK bytes from their start.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.flatnonzero(K.gear16(data) < CUT) + 1
    at = np.searchsorted(offs, raw - 1, "right")
    raw = raw[(raw - offs[at - 1] >= MIN_CHUNK) & (offs[at] - raw >= MIN_CHUNK)]
    if len(raw):
        base = offs[np.searchsorted(offs, raw - 1, "right") - 1]
        before = np.append(-MIN_CHUNK, raw[:-1])
        raw = raw[(raw - before >= MIN_CHUNK) | (before <= base)]
    ends = np.unique(np.concatenate([raw, offs[1:][offs[1:] > offs[:-1]]]))
    starts = np.append(0, ends[:-1])
    long = np.flatnonzero(ends - starts > MAX_CHUNK)
    if len(long):
        ends = np.unique(np.concatenate([ends, *[np.arange(starts[i] + MAX_CHUNK, ends[i], MAX_CHUNK) for i in long]]))
    is_end = np.zeros(len(data) + 1, bool)
    is_end[offs] = True
    for _ in range(3):
        inner = ~is_end[ends]
        ends = ends + (inner & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80))
    ends = np.unique(ends)
    return np.append(0, ends[:-1]), ends


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.flat(batch.column(0))
        for _, _, d, o in K.blocks(data, offs):
            yield pa.RecordBatch.from_arrays([pa.array(K.PrefixHash(d).of(*chunk_bounds(d, o)).view(np.int64))], ["h"])


def _digests(again: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offs = K.flat(batch.column(1))
            for i, _, d, o in K.blocks(data, offs):
                s, e = chunk_bounds(d, o)
                keep = maybe(again.value, K.PrefixHash(d).of(s, e))
                s, e = s[keep], e[keep]
                text = d.tobytes()
                digests = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                ab = np.frombuffer(digests, np.int64).reshape(-1, 2)
                doc = np.searchsorted(o, s, "right") - 1
                at = ((s - o[doc]) << 12 | (e - s)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), ids.take(pa.array(i + doc)), pa.array(at)], ["a", "b", "id", "at"])

    return run


def runs(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Adjoining (start, length) joined to (start, end): those of MIN_RUN bytes or more, or that are the whole text of so many bytes."""
    out: list[list[int]] = []
    for s, n in sorted(spans):
        if out and out[-1][1] == s:
            out[-1][1] = s + n
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out if e - s >= MIN_RUN or e - s == length]


def _cutter(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, sources = [], [], []
            data, offs = K.flat(batch.column(text_at))
            there = batch.column(text_at).is_valid().to_pylist()
            spans, origins = batch.column(text_at + 1).to_pylist(), batch.column(text_at + 2).to_pylist()
            for row, ok in enumerate(there):
                d = data[offs[row] : offs[row + 1]]
                gone = runs([(x >> 12, x & 4095) for x in set(spans[row])], len(d)) if spans[row] and ok else []
                if not gone:
                    texts.append(d.tobytes() if ok else None)
                    removed.append(0)
                    sources.append([])
                    continue
                edges = [0, *(x for g in gone for x in g), len(d)]
                texts.append(b"".join(d[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2)))
                removed.append(sum(e - s for s, e in gone))
                inside = {o for x, o in zip(spans[row], origins[row], strict=True) if any(s <= x >> 12 < e for s, e in gone)}
                sources.append(sorted(inside))
            cols = [x for j, x in enumerate(batch.columns) if j < text_at]
            kind = batch.schema.field(text_at + 2).type
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64()), pa.array(sources, kind)], [*batch.schema.names[:text_at], "_text", "_removed", "_from"])

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeats cut out of text_col, removed_bytes (bigint) and repeated_from (ids where the kept text is).

    Every row of df is returned. Null and empty texts stay as they are, rows with a null id are neither searched nor
    cut, and rows that share an id count as one document and are cut where any of them is. A document all of whose text is kept elsewhere is left with ''.
    Repeats inside one document count too. Of ties the occurrence of the least (id, start) stays. Texts of any length are read whole. An empty table
    gives an empty result. Other columns are carried, whatever their names and types; columns named removed_bytes or repeated_from, in any
    case, are replaced.
    """
    table = carry(df, id_col, text_col, "removed_bytes", "repeated_from")
    id_type = kind(df, id_col)
    src = ids_and_texts(df, id_col, text_col)
    again = df.sparkSession.sparkContext.broadcast(repeated(src.select("text").mapInArrow(_hashes, "h bigint")))
    chunks = src.mapInArrow(_digests(again), StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("id", id_type), StructField("at", LongType())]))
    first = chunks.groupBy("a", "b").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = chunks.join(first.select("a", "b", "first"), ["a", "b"]).filter("not (id = first.id and at = first.at)")
    gone = marked.groupBy("id").agg(F.collect_list(F.struct("at", F.col("first.id").alias("origin"))).alias("x")).select(F.col("id").alias("_id"), F.col("x.at").alias("_at"), F.col("x.origin").alias("_origin"))
    joined = table.base.join(gone, F.col(table.id) == F.col("_id"), "left").drop("_id")
    out = joined.mapInArrow(_cutter(table.n), table.schema(("_text", StringType()), ("_removed", LongType()), ("_from", ArrayType(id_type))))
    return table.result(out, "_text", ("_removed", "removed_bytes"), ("_from", "repeated_from"))
