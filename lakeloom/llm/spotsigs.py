"""Document fingerprints by spot signatures.

A spot is a common word (an anchor) and the CHAIN content words that follow it; a document's fingerprint
is the set of its spots. Pairs whose sets have a Jaccard similarity of at least the threshold are found
exactly: sets are partitioned by length so that partners lie in the same or the next partition, and only
pairs that share one of their rarest spots, agree in length and can still reach the needed overlap are
compared. Spots of a single document can't be shared: they count for lengths and the order but go no further.

Passes: (1) spots, counted; (2) a 128-bit digest of each document's fingerprint, and those of its spots that may be shared, the rarest first, by
bitmaps of the first pass. Documents of one fingerprint are a class, and only its least id is compared with others: however many copies
there are, the result has a row for each document, and no group is gathered in one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import bytes_kernel as K
from .frames import ids_and_texts, kind
from .repeats import frequencies, levels
from .scratch import Scratch

CHAIN = 2
ANCHORS = "the a an is was are der die das ist le la les est el los las es".split()
#: Words that are neither anchors nor content.
COMMON = "of and to in it that with as by for on be from this at or und in von zu mit den dem ein eine auf für nicht im sich auch et de du des un une que qui dans pour par sur au pas avec y en que del un una por con para se lo al su no or not but if".split()


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(np.array([K.word_hash(w) for w in words], np.uint64))


_sets: dict[str, np.ndarray] = {}


def spots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct spots of each document of a block, and their documents, in order of document."""
    if not _sets:
        _sets["anchor"] = _hashes(ANCHORS)
        _sets["stop"] = _hashes(ANCHORS + COMMON)
    h, doc, _ = K.words(data, offs)
    content = np.flatnonzero(~np.isin(h, _sets["stop"]))
    anchors = np.flatnonzero(np.isin(h, _sets["anchor"]))
    k = np.searchsorted(content, anchors, "right")
    ok = k + CHAIN <= len(content)
    anchors, k = anchors[ok], k[ok]
    ok = doc[content[k + CHAIN - 1]] == doc[anchors] if len(k) else np.zeros(0, bool)
    anchors, k = anchors[ok], k[ok]
    s = h[anchors] * K.U(0x9FB21C651E98DF25)
    for c in range(CHAIN):
        s = K.mix(s) + h[content[k + c]] * K.U(0xA0761D6478BD642F)
    s, d = K.mix(s), doc[anchors]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def _spot_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.flat(batch.column(0))
        for _, _, d, o in K.blocks(data, offs):
            yield pa.RecordBatch.from_arrays([pa.array(spots(d, o)[0].view(np.int64))], ["h"])


def _prints(seen: Broadcast):
    """For each document (id, spots, digest of the fingerprint, its spots that may be shared, the rarest first).

    The digest of a document without spots is that of its text. Rarity is by level, ties by value: one order for all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offs = K.flat(batch.column(1))
            for i, j, d, o in K.blocks(data, offs):
                s, doc = spots(d, o)
                n = np.bincount(doc, minlength=j - i).astype(np.int32)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                whole = [s[first[k] : first[k + 1]] if n[k] else d[o[k] : o[k + 1]] for k in range(j - i)]
                ab = np.frombuffer(b"".join(blake2b(x.tobytes(), digest_size=16).digest() for x in whole), np.int64).reshape(-1, 2)
                level = levels(seen.value, s)
                s, doc, level = s[level >= 0], doc[level >= 0], level[level >= 0]
                order = np.lexsort((s, level, doc))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)), pa.array(s[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), lists], ["id", "n", "a", "b", "s"])

    return run


def _classes_and_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of every document, and (ia, ib, jaccard) of the classes at or above the threshold, in no order."""
    scratch = Scratch(df.sparkSession, "spots")
    src = ids_and_texts(df, id_col, text_col).filter("text <> ''")
    seen = df.sparkSession.sparkContext.broadcast(frequencies(src.select("text").mapInArrow(_spot_hashes, "h bigint")))
    schema = StructType([StructField("id", kind(df, id_col)), StructField("n", IntegerType()), StructField("a", LongType()), StructField("b", LongType()), StructField("s", ArrayType(LongType()))])
    rows = scratch.keep(src.mapInArrow(_prints(seen), schema), "rows")
    heads = scratch.keep(rows.groupBy("n", "a", "b").agg(F.min(F.struct("id", "s")).alias("p")).select("n", "a", "b", F.col("p.id").alias("id"), F.col("p.s").alias("s")), "heads")
    classes = rows.select("id", "n", "a", "b").join(heads.select("n", "a", "b", F.col("id").alias("class_id")), ["n", "a", "b"])
    classes = classes.groupBy("id").agg(F.min("class_id").alias("class_id"))
    points = heads.select("id", "n", "s").filter((F.size("s") > 0) & (F.size("s") >= F.ceil(F.col("n") * threshold - 1e-9)))
    own = F.col("n") - F.size("s")
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - own).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    keyed = points.select("id", "n", F.size("s").alias("k"), band.alias("band"), F.posexplode(F.slice("s", F.lit(1), prefix)).alias("at", "spot"))
    left = keyed.select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("at").alias("pa"), "band", "spot")
    right = keyed.select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("at").alias("pb"), F.explode(F.array("band", F.col("band") - 1)).alias("band"), "spot")
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    reach = F.least(F.col("ka") - F.col("pa"), F.col("kb") - F.col("pb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ia") < F.col("ib")))
    candidates = left.join(right, ["band", "spot"]).filter(ordered & (F.col("na") >= F.col("nb") * threshold - 1e-9) & (reach >= need)).select("ia", "ib").distinct()
    a = points.select(F.col("id").alias("ia"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = points.select(F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("double")
    verified = candidates.join(a, "ia").join(b, "ib").select("ia", "ib", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)
    return classes, verified


def class_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_a, id_b, jaccard): id_a < id_b, every pair of classes whose fingerprints reach the threshold, by their least ids, exactly."""
    _, pairs = _classes_and_pairs(df, id_col, text_col, threshold)
    return pairs.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), "jaccard")


def fingerprint_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, class_id, links) of every document that has an id and a text, each id once.

    class_id: the least id among the documents of one fingerprint. links: how many other classes have a fingerprint whose Jaccard
    similarity with this one is at least the threshold; every pair counts. Documents without a spot have no fingerprint: those of one text
    are a class, and have no links. Null and empty texts and rows with a null id are not in the result. Texts of any length are read whole. Rows that
    share an id must be copies; else the id is in the least class among theirs. An empty table gives an empty result. Other columns are not read.
    """
    classes, pairs = _classes_and_pairs(df, id_col, text_col, threshold)
    links = pairs.select(F.explode(F.array("ia", "ib")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    out = classes.join(links, "class_id", "left")
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
