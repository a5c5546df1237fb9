"""Vectorised text primitives shared by the training-data operators.

Everything here works on whole Arrow string columns through their raw buffers, so the
cost of a pass is a handful of numpy operations per byte instead of a Python call per row.
Texts are always read in full; work is cut into slices of whole rows, so a very long
document is one slice of its own and never truncated.

Null texts count as empty everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

U64 = np.uint64
SLICE_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

_rng = np.random.default_rng(20240229)
_POINT_CODE = _rng.integers(1, 1 << 63, 1 << 16, dtype=U64) | U64(1)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=U64) | U64(1)

#: Bytes that belong to a word: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    WORD_BYTE[_c] = True
WORD_BYTE[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the hash base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n).bit_length())
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, spreading every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Prefix sums of a polynomial hash: the hash of any substring in O(1)."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[: len(codes)], dtype=U64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), with the length mixed in."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(col.type) and not pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the rows' offsets into them."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about size bytes; a longer row is a range of its own."""
    if not len(col):
        return
    off = raw(col)[1]
    at = 0
    while at < len(col):
        to = int(np.searchsorted(off, off[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(col))
        yield at, to
        at = to


class Words:
    """The lower-case words of some rows: byte spans, row numbers and 64-bit hashes."""

    def __init__(self, col: pa.Array):
        data, off = raw(pc.utf8_lower(col))
        self.rows = len(col)
        is_word = WORD_BYTE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data):
            before[1:], after[:-1] = is_word[:-1], is_word[1:]
            firsts = off[:-1][off[:-1] < off[1:]]
            before[firsts] = False
            after[firsts[1:] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.data = data
        self.hash = Prefix(_BYTE_CODE[data]).of(self.start, self.end) if len(self.start) else np.zeros(0, U64)
        self.counts = np.bincount(self.row, minlength=self.rows) if self.rows else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.position = np.arange(len(self.row)) - self.first[self.row]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a row, and the index of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = mix(h * U64(0x9FB21C651E98DF25) + self.hash[j : j + n])
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return h[at], at

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def word_hashes(text: str) -> np.ndarray:
    return Words(pa.array([text])).hash


class Lines:
    """The lines of some rows, split at newlines only, as code points.

    codes holds all rows joined by newlines; line i is codes[start[i]:end[i]].
    A row without text has one empty line.
    """

    def __init__(self, col: pa.Array):
        texts = col.to_pylist()
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.flatnonzero(self.codes == 10)
        self.start = np.concatenate([[0], breaks + 1]).astype(np.int64)
        self.end = np.concatenate([breaks, [len(self.codes)]]).astype(np.int64)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.row = np.searchsorted(begins, self.start, "right") - 1
        first = np.searchsorted(self.row, np.arange(len(texts)))
        self.number = np.arange(len(self.row)) - first[self.row] if len(texts) else np.zeros(0, np.int64)
        self.length = self.end - self.start

    def coded(self) -> np.ndarray:
        """A random 64-bit code for every code point of the basic plane; the planes above shift it."""
        out = _POINT_CODE[self.codes & np.uint32(0xFFFF)]
        above = np.flatnonzero(self.codes >> np.uint32(16))
        if len(above):
            out[above] += (self.codes[above] >> np.uint32(16)).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
        return out

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint."""
    return pa.array(x.view(np.int64) if x.dtype == U64 else x, pa.int64())


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]], zero where a segment is empty."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return sums[first[1:]] - sums[first[:-1]]


def unused(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as make it a name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
