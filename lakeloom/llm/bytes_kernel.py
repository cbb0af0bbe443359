"""Whole-block byte kernels in numpy: hashes of any substring from prefix sums, words, gear hashes.

Every function works on a block of documents laid end to end in one uint8 array, so that the
interpreter runs per block and not per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U = np.uint64


def _table(seed: int, bits: int = 64) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**bits - 1, 256, dtype=np.uint64)


GEAR = _table(11)
GEAR_B = _table(12)
BASES = ((U(0x9E3779B97F4A7C15), U(0xF1DE83E19937733D)), (U(0xD6E8FEB86659FD93), U(0xCFEE444D8B59A89B)))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (BASES[which][0], U(pow(int(BASES[which][0]), -1, 2**64))):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.cumprod(p))
        have = _powers[which] = (out[0], out[1])
    return have


class PrefixHash:
    """64-bit polynomial hashes of substrings of one block, each in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.down = powers(n + 1, which)[1]
        terms = (GEAR if which == 0 else GEAR_B)[data] * powers(n + 1, which)[0][:n]
        self.sums = np.zeros(n + 1, U)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about size bytes: first row, end row, bytes, offsets from 0."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _fold() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[ord("A") : ord("Z") + 1] += 32
    for c in range(128):
        if not chr(c).isalnum():
            lut[c] = 32
    return lut


FOLD = _fold()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its document in the block, and the first word of each document (n+1).

    A word is a run of letters, digits and non-ASCII bytes; ASCII case is folded.
    """
    b = FOLD[data]
    inside = b != 32
    edge = np.zeros(len(b) + 1, bool)
    edge[offs[:-1]] = True
    before = np.zeros(len(b), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(b), bool)
    after[:-1] = inside[1:]
    edge_next = np.zeros(len(b), bool)
    last = offs[1:] - 1
    edge_next[last[(last >= 0) & (offs[1:] > offs[:-1])]] = True
    end = np.flatnonzero(inside & (~after | edge_next)) + 1
    h = PrefixHash(b).of(start, end)
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    return h, doc, first


def word_hash(word: str) -> int:
    """The hash that words() gives this one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]))[0][0])


def shingles(h: np.ndarray, doc: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of width words inside a document, and their documents. A document of fewer words is one shingle."""
    n = len(h)
    mult = [U(0x9FB21C651E98DF25), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]
    acc = np.zeros(n, U)
    for k in range(width):
        acc[: n - k] += h[k:] * mult[k]
    ends = first[1:][doc]
    counts = np.diff(first)
    ok = np.arange(n) + width <= ends
    short = (counts < width)[doc] & (np.arange(n) == first[:-1][doc])
    keep = ok | short
    return mix(acc[keep]), doc[keep]


def gear16(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] modulo 2**16 after each byte: it depends on 16 bytes."""
    h = GEAR.astype(np.uint16)[data]
    for s in (1, 2, 4, 8):
        t = h.copy()
        t[s:] += h[:-s] << np.uint16(s)
        h = t
    return h
