"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of WINDOW adjacent lines is taken at every line. A chunk is a longest run of lines
in which every window's hash occurs more than once in the corpus: a boundary lies where one occurs once. Both depend on the
lines in the window only, so that inserted or lost lines move no boundary but those next to them. (Boundaries where the hash is
divisible by a constant, the usual rule, cut repeated passages of 2 to 7 lines, which are the common ones, apart: README has figures.)
Chunks have WINDOW lines at least. Their windows are removed where they repeat an earlier one byte for byte.

Passes: (1) rolling hashes, counted; (2) the bytes of the windows that may repeat, by a bitmap of the first pass, compared by a join on the bytes; (3)
the documents, cut. A window that occurs everywhere is one row of each task after partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import bytes_kernel as K
from .frames import carry, ids_and_texts, kind
from .repeats import maybe, repeated

WINDOW = 2


def lines_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end and end without the newline of each line of a block.

    A line is what ends with a newline or with its document; its newline belongs to it.
    """
    full = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offs[1:][offs[1:] > offs[:-1]]])).astype(np.int64)
    start = np.append(0, full[:-1]) if len(full) else full
    doc = np.searchsorted(offs, start, "right") - 1
    return doc, start, full, full - (data[full - 1] == 10) if len(full) else full


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, line in it, start, end, rolling hash) of every window of WINDOW lines that isn't blank.

    The last newline doesn't count, since a document's last line may lack it.
    """
    doc, start, full, bare = lines_of(data, offs)
    n = max(0, len(start) - WINDOW + 1)
    h = K.PrefixHash(data).of(start, bare)
    roll = np.zeros(n, K.U)
    for k in range(WINDOW):
        roll = roll * K.U(0x9FB21C651E98DF25) + h[k : n + k]
    space = np.append(0, np.cumsum(~np.isin(data, (9, 10, 11, 12, 13, 32))))
    ok = (doc[:n] == doc[WINDOW - 1 :]) & (space[bare[WINDOW - 1 :]] > space[start[:n]]) if n else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    line = at - np.searchsorted(doc, doc[at])
    return doc[at], line, start[at], bare[at + WINDOW - 1], K.mix(roll[at])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.flat(batch.column(0))
        for _, _, d, o in K.blocks(data, offs):
            yield pa.RecordBatch.from_arrays([pa.array(windows(d, o)[4].view(np.int64))], ["h"])


def _candidates(again: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offs = K.flat(batch.column(1))
            for i, _, d, o in K.blocks(data, offs):
                doc, line, s, e, h = windows(d, o)
                keep = maybe(again.value, h)
                text = d.tobytes()
                found = [text[a:b] for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), ids.take(pa.array(i + doc[keep])), pa.array(line[keep]), pa.array(found, pa.binary())], ["h", "id", "k", "bytes"])

    return run


def _cut(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            data, offs = K.flat(batch.column(text_at))
            there = batch.column(text_at).is_valid().to_pylist()
            for row, gone in enumerate(batch.column(text_at + 1).to_pylist()):
                d = data[offs[row] : offs[row + 1]]
                text = d.tobytes()
                if not gone or not there[row]:
                    texts.append(text if there[row] else None)
                    removed.append(0)
                    continue
                _, line, _, _, h = windows(d, np.array([0, len(d)]))
                mine = dict(zip(line.tolist(), h.view(np.int64).tolist(), strict=True))
                _, start, full, _ = lines_of(d, np.array([0, len(d)]))
                stay = np.ones(len(start), bool)
                for x in gone:
                    if mine.get(x["k"]) == x["h"]:  # else the window is of another row of this id
                        stay[x["k"] : x["k"] + WINDOW] = False
                texts.append(b"".join(text[s:e] for s, e in zip(start[stay].tolist(), full[stay].tolist(), strict=True)))
                removed.append(int((~stay).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], [*batch.schema.names[:text_at], "_text", "_removed"])

    return run


def dedup_line_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without repeated runs of WINDOW or more lines, and with removed_lines (bigint) as its last column.

    A window stays where it first occurs, in order of (id, line); the lines of its other occurrences go,
    but for those that overlap the first in its own document. So every line's text stays where it first occurs, though
    the lines of one run may stay in several documents. Windows of blank lines only don't count.
    Null and empty texts stay; a document that had text and has none left is dropped. Texts and lines of any length are read whole.
    Rows with a null id stay untouched and are not counted. Rows that share an id are each cut where they hold what is removed under that id
    at the same line. An empty table gives an empty result. Other columns are carried, whatever their names and types; a column
    named removed_lines, in any case, is replaced.
    """
    table = carry(df, id_col, text_col, "removed_lines")
    src = ids_and_texts(df, id_col, text_col)
    again = df.sparkSession.sparkContext.broadcast(repeated(src.select("text").mapInArrow(_hashes, "h bigint")))
    found = src.mapInArrow(_candidates(again), StructType([StructField("h", LongType()), StructField("id", kind(df, id_col)), StructField("k", LongType()), StructField("bytes", BinaryType())]))
    first = found.groupBy("h", "bytes").agg(F.min(F.struct("id", "k")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # the join on the bytes is the comparison
    later = found.join(first.select("h", "bytes", "first"), ["h", "bytes"]).filter(f"id <> first.id or k >= first.k + {WINDOW}")
    gone = later.groupBy("id").agg(F.collect_list(F.struct("k", "h")).alias("_gone")).withColumnRenamed("id", "_id")
    joined = table.base.join(gone, F.col(table.id) == F.col("_id"), "left").drop("_id")
    out = joined.mapInArrow(_cut(table.n), table.schema(("_text", StringType()), ("_removed", LongType())))
    out = out.filter((F.col("_removed") == 0) | (F.length(F.trim(F.translate("_text", "\n\r\t", "   "))) > 0))
    return table.result(out, "_text", ("_removed", "removed_lines"))
