"""Operator 6, language-model scoring by context-tree weighting.

Bytes are predicted bit by bit: each of the 255 inner nodes of the byte's binary tree has a context tree of its own, whose contexts are the last
0 to DEPTH bytes. Every context estimates the bit by Krichevsky and Trofimov; the weighting mixes the estimates of all depths, each
context with its longer ones, by how well they code the corpus. A document's score is its code length per byte under this mixture.

The corpus enters as counts of (DEPTH + 1)-grams, gathered from all documents with a combiner in every task. From depth 2 on, the trees fall
apart by the last two context bytes, so they are built in GROUPS independent groups of these; only sums by last context byte meet on the driver,
255 for each at most. All bits of a position depend on its gram alone, so the model ends as one code length per gram. Up to
BROADCAST_GRAMS that table is sent to the executors and looked up in place; a larger one is cut into parts of that size by hash, which are sent one after another,
each for a pass over the texts that gives one number per document. So neither texts nor their grams are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.textkit import mix, raw, slices, text_column
from quillgraph.storage import cut, remove, stored

#: Longest context, in bytes; at most MAX_DEPTH, where a gram still fits a positive bigint.
DEPTH = 5
MAX_DEPTH = 6
#: Groups of contexts by their last two bytes; one group's trees are in memory at once.
GROUPS = 512
#: Grams that a worker holds before it sums them and passes them on.
COUNTED = 1 << 19
#: Most grams in a table that is sent out; a worker's copy takes up to 32 bytes for each, and is built once.
BROADCAST_GRAMS = 4_000_000
#: Parts of a larger table have so many grams at least, as each is a pass over the texts.
PART_GRAMS = 1 << 16

_LOG2 = np.log(2.0)


def gram_codes(data: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """For every byte, itself and its depth predecessors in one number, the byte lowest; before a row's start stand zeros."""
    code = data.astype(np.uint64)
    firsts = off[:-1]
    for s in range(1, depth + 1):
        before = np.zeros(len(data), np.uint64)
        before[s:] = data[:-s]
        for j in range(s):
            before[(firsts + j)[firsts + j < len(data)]] = 0
        code |= before << np.uint64(8 * s)
    return code


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    gram, at = np.unique(codes, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(np.bincount(at, n, len(gram)).astype(np.int64))], ["gram", "n"])


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        col = text_column(batch)
        for a, b in slices(col):
            parts.append(np.unique(gram_codes(*raw(col.slice(a, b - a)), depth), return_counts=True))
            if sum(len(codes) for codes, _ in parts) > COUNTED:
                yield _summed(parts)
                parts = []
    if parts:
        yield _summed(parts)


_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5 (Lanczos)."""
    x = x - 1.0
    total = np.full_like(x, 0.99999999999980993)
    for i, c in enumerate(_LANCZOS):
        total += c / (x + i + 1)
    t = x + 7.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def shorter(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys with only the last d bytes of their contexts."""
    return ((keys >> 8) & ((1 << (8 * d)) - 1)) * 256 + (keys & 255)


class Trees:
    """The context trees over all grams of some last context bytes, from the leaves up to depth base.

    Level 0 of the lists is the deepest. A key is context * 256 + bit node.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int, base: int):
        byte = (gram & 255).astype(np.int64)
        context = (gram >> 8).astype(np.int64)
        k = np.arange(8)
        node = (1 << k) | (byte[:, None] >> (8 - k))
        self.bit = ((byte[:, None] >> (7 - k)) & 1).ravel()
        keys, at = np.unique((context[:, None] * 256 + node).ravel(), return_inverse=True)
        weight = np.repeat(n.astype(float), 8)
        ones = np.bincount(at, weight * self.bit, len(keys))
        zeros = np.bincount(at, weight, len(keys)) - ones
        self.at = [at]  # of each gram's bits, then of each level's keys, the key one level up
        self.keys, self.zeros, self.ones = [keys], [zeros], [ones]
        self.log_kt = [log_kt(zeros, ones)]
        self.log_weighted = [self.log_kt[0]]
        for d in range(depth - 1, base - 1, -1):
            keys, at = np.unique(shorter(keys, d), return_inverse=True)
            zeros, ones = np.bincount(at, zeros, len(keys)), np.bincount(at, ones, len(keys))
            below = np.bincount(at, self.log_weighted[-1], len(keys))
            own = log_kt(zeros, ones)
            self.at.append(at)
            self.keys.append(keys)
            self.zeros.append(zeros)
            self.ones.append(ones)
            self.log_kt.append(own)
            self.log_weighted.append(np.logaddexp(own, below) - _LOG2)

    def top(self) -> tuple[np.ndarray, ...]:
        """(key, zeros, ones, log weighted probability) at depth base."""
        return self.keys[-1], self.zeros[-1], self.ones[-1], self.log_weighted[-1]

    def bits(self, above: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Code length of each gram's byte; above has the levels over base: their keys, own weights and estimates of a one."""
        where = self.at[0]
        at = [where]
        for up in self.at[1:]:
            where = up[where]
            at.append(where)
        p = None
        for level, w in enumerate(at):
            one = (self.ones[level] + 0.5) / (self.zeros[level] + self.ones[level] + 1)
            own = np.where(self.bit == 1, one[w], 1 - one[w])
            if p is None:
                p = own
            else:
                stop = np.exp(self.log_kt[level] - _LOG2 - self.log_weighted[level])[w]
                p = stop * own + (1 - stop) * p
        for d, (keys, stop, one) in zip(range(len(above) - 1, -1, -1), above):
            w = np.searchsorted(keys, shorter(self.keys[-1], d))[at[-1]]
            own = np.where(self.bit == 1, one[w], 1 - one[w])
            p = stop[w] * own + (1 - stop[w]) * p
        return -np.log2(p).reshape(-1, 8).sum(axis=1)


def _tops(table: pa.Table, depth: int, base: int) -> pa.Table:
    trees = Trees(table.column("gram").to_numpy(), table.column("n").to_numpy(), depth, base)
    return pa.table(dict(zip(("key", "zeros", "ones", "weighted"), trees.top())))


def _costs(table: pa.Table, depth: int, base: int, above: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    gram = table.column("gram")
    trees = Trees(gram.to_numpy(), table.column("n").to_numpy(), depth, base)
    return pa.table({"gram": gram, "bits": trees.bits(above)})


def gram_costs(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, bits): the code length of a byte in its context, for every gram of the corpus."""
    base = min(2, depth)
    counted = texts.select("text").mapInArrow(lambda it: _count(it, depth), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    last = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * base)) - 1))
    counts = cut(counted.withColumn("g", F.pmod(F.xxhash64(last), F.lit(GROUPS)).cast("int")))
    tops = counts.groupBy("g").applyInArrow(lambda t: _tops(t, depth, base), "key bigint, zeros double, ones double, weighted double")
    key = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * (base - 1))) - 1)) * 256 + F.col("key").bitwiseAND(F.lit(255))
    sums = tops.groupBy(key.alias("key")).agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).orderBy("key").toArrow()  # 256 * 255 rows at most
    keys, zeros, ones, below = (sums.column(i).to_numpy() for i in range(4))
    above = []
    for d in range(base - 1, -1, -1):
        if d < base - 1:
            keys, at = np.unique(shorter(keys, d), return_inverse=True)
            zeros, ones, below = (np.bincount(at, x, len(keys)) for x in (zeros, ones, weighted))
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, below) - _LOG2
        above.append((keys, np.exp(own - _LOG2 - weighted), (ones + 0.5) / (zeros + ones + 1)))
    return counts.groupBy("g").applyInArrow(lambda t: _costs(t, depth, base, above), "gram bigint, bits double")


class CostTable:
    """Code lengths by gram, in an open hash table of 12 bytes a slot that is at most three quarters full and looked up by whole arrays."""

    #: No gram: grams have at most 56 bits.
    FREE = np.uint64((1 << 64) - 1)

    def __init__(self, gram: np.ndarray, bits: np.ndarray):
        self.shift = np.uint64(64 - max(12, int(max(1, len(gram)) * 4 / 3).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), self.FREE, np.uint64)
        self.bits = np.zeros(len(self.keys), np.float32)
        for at in range(0, len(gram), 1 << 20):  # in parts, so that little is held beside the table
            self._put(gram[at : at + (1 << 20)], bits[at : at + (1 << 20)])

    def _put(self, gram: np.ndarray, bits: np.ndarray) -> None:
        todo, slot = np.arange(len(gram)), self._slot(gram)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == self.FREE)
            at, first = np.unique(slot[free], return_index=True)
            put = todo[free][first]
            self.keys[at], self.bits[at] = gram[put], bits[put]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo, slot = todo[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (mix(gram) >> self.shift).astype(np.int64)

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Bits of grams, zero for those that are not in the table."""
        slot = self._slot(gram)
        wrong = np.flatnonzero((self.keys[slot] != gram) & (self.keys[slot] != self.FREE))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[wrong]]
            wrong = wrong[(there != gram[wrong]) & (there != self.FREE)]
        return self.bits[slot].astype(float)  # a free slot has zero bits


_built: tuple[object, CostTable] | None = None


def _table(shared) -> CostTable:
    """The table of a broadcast, built by the first task of a worker that needs it and kept for the others."""
    global _built
    value = shared.value
    if _built is None or _built[0] is not value:
        _built = None
        _built = value, CostTable(*value)
    return _built[1]


def _score(batches: Iterator[pa.RecordBatch], shared, depth: int, key: str) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, bits): of each text, the bits of its grams that are in the table."""
    table = _table(shared)
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index(key))
        for a, b in slices(col):
            data, off = raw(col.slice(a, b - a))
            sums = np.concatenate([[0.0], np.cumsum(table.of(gram_codes(data, off, depth)))])
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off)), pa.array(sums[off[1:]] - sums[off[:-1]])], [key, "n_bytes", "bits"])


def _sent(costs: DataFrame):
    """A table of costs as a broadcast."""
    table = costs.toArrow()
    return costs.sparkSession.sparkContext.broadcast((table["gram"].to_numpy().astype(np.uint64), table["bits"].to_numpy().astype(np.float32)))


def _in_passes(texts: DataFrame, costs: DataFrame, depth: int, parts: int) -> DataFrame:
    """(doc_id, n_bytes, bits) by so many parts of the table. Texts are stored once, compressed and with numbers, so that repeated documents stay apart."""
    rows = stored(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    passes = None
    for k in range(parts):
        shared = _sent(costs.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k))
        scored = cut(rows.select("row", "text").mapInArrow(lambda it: _score(it, shared, depth, "row"), "row bigint, n_bytes bigint, bits double"))
        shared.destroy()
        passes = scored if passes is None else passes.union(scored)
    sums = cut(passes.groupBy("row").agg(F.max("n_bytes").alias("n_bytes"), F.sum("bits").alias("bits")))
    out = cut(rows.select("row", "doc_id").join(sums, "row").select("doc_id", "n_bytes", "bits"))
    remove(rows)
    return out


def code_lengths(docs: DataFrame, depth: int = DEPTH, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every document, under a model of all documents.

    Texts are UTF-8 bytes, read in full; a context that would reach before the text's start has zero bytes there. A null or empty text
    has 0 bytes, 0 bits and a null bits_per_byte; very long texts cost in proportion. A null doc_id is kept; repeated rows count as often as they come and are each given. An empty
    table gives an empty result; other columns are not read.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    costs = cut(gram_costs(texts, depth))
    grams = costs.count()
    if grams <= broadcast_grams:
        shared = _sent(costs)
        scored = texts.mapInArrow(lambda it: _score(it, shared, depth, "doc_id"), "doc_id bigint, n_bytes bigint, bits double")
    else:
        scored = _in_passes(texts, costs, depth, max(2, -(-grams // max(PART_GRAMS, broadcast_grams))) if grams else 1)
    return scored.withColumn("bits_per_byte", F.try_divide("bits", "n_bytes"))
