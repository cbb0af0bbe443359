"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, FILTERS learned filters run over overlapping chunks of WIDTH bytes, STRIDE apart, which cover the
whole document, each filter is max-pooled over the document, and the pooled values are combined into one
probability. For inference, embedding and filters fold into tables over byte pairs, so that a chunk costs
WIDTH / 2 lookups.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import bytes_kernel as K
from .frames import numbered, position

EMBED, FILTERS, WIDTH, STRIDE = 6, 16, 8, 2
PAIRS = WIDTH // 2
BLOCK = 1 << 17


class ByteCNN:
    """emb (256 x EMBED), filt (WIDTH x EMBED x FILTERS), bias (FILTERS), w (FILTERS), b."""

    def __init__(self, emb: np.ndarray, filt: np.ndarray, bias: np.ndarray, w: np.ndarray, b: float):
        self.emb, self.filt, self.bias, self.w, self.b = emb, filt, bias, w, b
        self.fold()

    @classmethod
    def fresh(cls, seed: int) -> ByteCNN:
        r = np.random.default_rng(seed)
        f4 = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        return cls(f4(256, EMBED, k=0.5), f4(WIDTH, EMBED, FILTERS, k=1 / np.sqrt(WIDTH * EMBED)), np.zeros(FILTERS, np.float32), f4(FILTERS, k=0.3), 0.0)

    def fold(self) -> None:
        per = np.einsum("be,jef->jbf", self.emb, self.filt)  # WIDTH x 256 x FILTERS
        # a little-endian pair has its first byte low
        self.tables = [(per[2 * k][None, :, :] + per[2 * k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(PAIRS)]

    def pool(self, data: np.ndarray, offs: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Max of each filter per document, where it was (a byte of the padded block), and the padded block."""
        lens = np.diff(offs)
        chunks = np.maximum(1, -(-lens // STRIDE))
        padded = STRIDE * chunks + WIDTH - STRIDE
        at = np.concatenate([[0], np.cumsum(padded)])
        buf = np.zeros(at[-1], np.uint8)
        buf[np.arange(len(data)) + np.repeat(at[:-1] - offs[:-1], lens)] = data
        pairs = buf.view("<u2")
        n = len(pairs) - PAIRS + 1
        acc = self.tables[0][pairs[:n]]
        for k in range(1, PAIRS):
            acc += self.tables[k][pairs[k : k + n]]
        first = at[:-1] // STRIDE
        cuts = np.stack([first, np.minimum(first + chunks, n)], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] == n else cuts
        top = np.maximum.reduceat(acc, cuts, axis=0)[::2]
        pos = None
        if where:
            pos = self._places(acc, top, first, chunks) * STRIDE
        return top, pos, buf

    @staticmethod
    def _places(acc: np.ndarray, top: np.ndarray, first: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        """The first chunk of each document that has its maximum, for each filter."""
        doc = np.repeat(np.arange(len(chunks)), chunks)
        out = np.zeros(top.shape, np.int64)
        rows = np.concatenate([np.arange(f, f + c) for f, c in zip(first.tolist(), chunks.tolist(), strict=True)])
        for k in range(top.shape[1]):
            hit = np.flatnonzero(acc[rows, k] == top[doc, k])
            _, one = np.unique(doc[hit], return_index=True)
            out[:, k] = rows[hit[one]]
        return out

    def pool_long(self, data: np.ndarray, segment: int = BLOCK) -> np.ndarray:
        """Max of each filter over one document, segment by segment: memory is that of a segment, whatever the document's length."""
        top, at = np.full(FILTERS, -np.inf, np.float32), 0
        while at + segment + WIDTH - STRIDE < len(data):
            pairs = np.frombuffer(data[at : at + segment + WIDTH - STRIDE].tobytes(), "<u2")
            n = len(pairs) - PAIRS + 1
            acc = self.tables[0][pairs[:n]]
            for k in range(1, PAIRS):
                acc += self.tables[k][pairs[k : k + n]]
            top, at = np.maximum(top, acc.max(0)), at + segment
        return np.maximum(top, self.pool(data[at:], np.array([0, len(data) - at]))[0][0])

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        top = self.pool_long(data)[None] if len(offs) == 2 and len(data) > BLOCK else self.pool(data, offs)[0]
        hidden = np.maximum(top + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w + self.b, -50, 50)))

    def dump(self) -> str:
        return base64.b64encode(b"".join(np.asarray(x, np.float32).tobytes() for x in (self.emb, self.filt, self.bias, self.w, self.b))).decode()

    @classmethod
    def load(cls, text: str) -> ByteCNN:
        x = np.frombuffer(base64.b64decode(text), np.float32)
        sizes = np.cumsum([256 * EMBED, WIDTH * EMBED * FILTERS, FILTERS, FILTERS])
        e, f, b, w, c = np.split(x, sizes)
        return cls(e.reshape(256, EMBED), f.reshape(WIDTH, EMBED, FILTERS), b, w, float(c[0]))


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCNN:
    """Adam on the log loss; classes weigh alike. Only the chunk that won the pooling gets a gradient."""
    net, r = ByteCNN.fresh(seed), np.random.default_rng(seed)
    share = max(1, int((y == 1).sum())) / max(1, len(y))
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1e-9, 1 - share))
    params = ["emb", "filt", "bias", "w"]
    m = {k: np.zeros_like(getattr(net, k)) for k in params} | {"b": 0.0}
    v = {k: np.zeros_like(getattr(net, k)) for k in params} | {"b": 0.0}
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        step = rate * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            data = np.frombuffer(b"".join(texts[j] for j in rows), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(texts[j]) for j in rows])]).astype(np.int64)
            net.fold()
            top, pos, buf = net.pool(data, offs, True)
            z = top + net.bias
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.w + net.b, -30, 30)))
            d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dz = (d[:, None] * net.w[None, :]) * (z > 0)
            bytes_at = buf[pos[:, :, None] + np.arange(WIDTH)]  # docs x FILTERS x WIDTH
            e = net.emb[bytes_at]  # docs x FILTERS x WIDTH x EMBED
            g = {"w": hidden.T @ d, "b": float(d.sum()), "bias": dz.sum(0), "filt": np.einsum("df,dfwe->wef", dz, e), "emb": np.zeros_like(net.emb)}
            np.add.at(g["emb"], bytes_at.ravel(), np.einsum("df,wef->dfwe", dz, net.filt).reshape(-1, EMBED))
            t += 1
            for k in [*params, "b"]:
                grad = g[k] + (1e-4 * getattr(net, k) if k in ("filt", "w") else 0)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                setattr(net, k, getattr(net, k) - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8))
    net.fold()
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 1200, sample_bytes: int = 1 << 20) -> ByteCNN | float:
    """A network fitted on at most per_class labelled documents of each class, the first by md5 of the id.

    per_class and sample_bytes, the longest document that the sample takes, bound what the driver holds, and per_class the broadcast of
    ids. Rows with a null id or label, and documents of null text, are not used. Without labels of both classes: the one class there is (1.0 without any).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    picks = []
    for y in (0, 1):
        one = known.filter(F.col("_y") == y).withColumn("_h", F.md5(F.col("_id").cast("string"))).orderBy("_h", "_id").limit(per_class)
        picks += [(r[0], r[1]) for r in one.select("_id", "_y").collect()]
    sample = docs.sparkSession.createDataFrame(picks, f"_id {docs.schema[id_col].dataType.simpleString()}, _y int")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(F.octet_length("_t") <= sample_bytes).join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_id", "_y", "_t").collect()
    rows.sort(key=lambda r: r[0])
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 1.0
    return fit([r[2].encode() for r in rows], y.astype(np.float32))


def _scorer(model: str | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteCNN.load(model) if isinstance(model, str) else None
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            out = np.full(batch.num_rows, model if net is None else 0.0)
            data, offs = K.flat(col)
            if net is not None:
                for i, j, d, o in K.blocks(data, offs, BLOCK):
                    out[i:j] = net.probability(d, o)
            out[np.diff(offs) == 0] = 0.0
            p = pa.array(out, pa.float64(), mask=~np.asarray(col.is_valid()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], p], [*batch.schema.names[:-1], "p"])

    return run


def score(docs: DataFrame, model: ByteCNN | float, cols: list[str], text_col: str = "text", name: str = "quality") -> DataFrame:
    """cols of docs and name: the probability (double) that the document is good, from all its bytes.

    Null text gives null and empty text 0; documents of any length are read whole, by segments. Rows that repeat get the same value.
    An empty table gives an empty result. A column of cols named as the result, in any case, is replaced.
    """
    at = [position(docs, c) for c in cols if c.lower() != name.lower()]
    plain = numbered(docs).select(*[f"c{i}" for i in at], F.col(f"c{position(docs, text_col)}").alias("_text"))
    schema = StructType([*(StructField(f"c{i}", docs.schema.fields[i].dataType) for i in at), StructField("p", DoubleType())])
    out = plain.mapInArrow(_scorer(model.dump() if isinstance(model, ByteCNN) else float(model)), schema)
    return out.toDF(*[docs.columns[i] for i in at], name)


def keep_good(docs: DataFrame, model: ByteCNN | float, least: float, text_col: str = "text") -> DataFrame:
    """docs whose probability is at least least, with their columns as they are; null and empty texts go."""
    n = len(docs.columns)
    plain = numbered(docs)
    schema = StructType([*(StructField(f.name, f.dataType) for f in plain.schema.fields), StructField("p", DoubleType())])
    fed = plain.select("*", F.col(f"c{position(docs, text_col)}").alias("_text"))
    out = fed.mapInArrow(_scorer(model.dump() if isinstance(model, ByteCNN) else float(model)), schema).filter(F.col("p") >= least)
    return out.select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
