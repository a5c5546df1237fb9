"""Operator 5, benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words with single spaces between them, in UTF-8 bytes. An item of n bytes may be matched
with up to n // ERROR_BYTES errors; cut into one piece more than that, one piece occurs unchanged wherever the item does. All positions
of all texts are looked up in the hashed heads of the pieces, in one vectorised pass; each hit names a diagonal, hits of neighbouring
diagonals are one candidate, and Myers' bit-parallel distance, on words as long as the item, verifies it.

The items are sent to the executors in groups of bounded size; a benchmark of several groups takes as many passes over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.textkit import _BYTE_CODE, U64, WORD_BYTE, Prefix, raw, slices, text_column
from quillgraph.storage import BROADCAST_BYTES, cut, hinted

#: One error is allowed for so many bytes of an item.
ERROR_BYTES = 16
#: Shorter items are no evidence of a leak and are left out.
MIN_ITEM_BYTES = 32
#: Lengths of piece heads that are looked up; a piece uses the longest that it has.
HEADS = (8, 12, 16)
#: Bytes of items sent to the executors at once.
GROUP_BYTES = 32 << 20


def normal_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of lower-case words, each followed by a space, and the rows' offsets into them."""
    data, off = raw(pc.utf8_lower(col))
    is_word = WORD_BYTE[data]
    ends = np.zeros(len(data), bool)
    if len(data):
        ends[:-1] = is_word[:-1] & ~is_word[1:]
        ends[-1] = is_word[-1]
        last = off[1:][off[1:] > off[:-1]] - 1
        ends[last] = is_word[last]
    # A word's last byte is kept twice; the second copy becomes its space.
    times = is_word.astype(np.int8) + ends
    kept = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
    out = np.repeat(data, times)
    out[kept[1:][ends] - 1] = 32
    return out, kept[off]


def normal(text: str | None) -> bytes:
    """One text's normal form, without the last space."""
    return normal_bytes(pa.array([text or ""]))[0].tobytes()[:-1]


def myers_find(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the place in text that is nearest to item, the first of several; None beyond most errors.

    Myers' algorithm with one word of len(item) bits.
    """
    n = len(item)
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n + 1, -1
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        x = eq | minus
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(x | up))
        minus = up & x
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def errors(n: int | np.ndarray, error_bytes: int = ERROR_BYTES) -> int | np.ndarray:
    return n // error_bytes


class Pieces:
    """Items cut into pieces, and the hashed heads of the pieces by head length, all in flat arrays.

    Items of one normal form are one item here; ids has the item_id of each, from first[k] on for item k.
    """

    #: Slots of the sieve for a code: a sixteenth of them is set, and two places are looked at.
    SIEVE = 16

    def __init__(self, ids: np.ndarray, texts: pa.Array, error_bytes: int, min_item: int):
        data, off = normal_bytes(texts)
        size = np.maximum(np.diff(off) - 1, 0)  # without the last space
        own: dict[bytes, list[int]] = defaultdict(list)
        for i in np.flatnonzero(size >= min_item):
            own[data[off[i] : off[i] + size[i]].tobytes()].append(int(ids[i]))
        self.texts = list(own)
        self.ids = np.array([i for group in own.values() for i in group], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(group) for group in own.values()])]).astype(np.int64)
        joined = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = errors(self.size, error_bytes)
        begin = np.cumsum(self.size) - self.size
        n = self.most + 1
        item = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        start, end = self.size[item] * nth // n[item], self.size[item] * (nth + 1) // n[item]
        head = end - start
        for q in HEADS:  # the longest head that the piece has, or all of a shorter piece
            head = np.where(end - start >= q, q, head)
        prefix = Prefix(_BYTE_CODE[joined])
        self.tables = []
        for q in np.unique(head):
            at = np.flatnonzero(head == q)
            place = begin[item[at]] + start[at]
            code = prefix.of(place, place + q)
            order = np.argsort(code, kind="stable")
            codes, first = np.unique(code[order], return_index=True)
            bits = max(16, int(len(codes) * self.SIEVE - 1).bit_length())
            sieve = np.zeros(1 << (bits - 3), np.uint8)
            for slot in self._slots(codes, bits):
                np.bitwise_or.at(sieve, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            owners = item[at][order].astype(np.int32), start[at][order].astype(np.int32)
            self.tables.append((int(q), codes, np.append(first, len(order)).astype(np.int32), *owners, sieve, bits))

    @staticmethod
    def _slots(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = U64((1 << bits) - 1)
        return (code >> U64(64 - bits)).astype(np.int64), (code & mask).astype(np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, offset of the piece within the item) of all places in data where a piece's head stands."""
        found = [(np.zeros(0, np.int64),) * 3]
        prefix = Prefix(_BYTE_CODE[data]) if self.tables else None
        for q, codes, first, item, offset, sieve, bits in self.tables:
            n = len(data) - q + 1
            if n <= 0:
                continue
            at = np.arange(n)
            code = prefix.of(at, at + q)
            high = code >> U64(64 - bits)
            maybe = np.flatnonzero((sieve[high >> U64(3)] >> (high & U64(7)).astype(np.uint8)) & 1)
            low = self._slots(code[maybe], bits)[1]
            maybe = maybe[((sieve[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)]
            where = np.minimum(np.searchsorted(codes, code[maybe]), len(codes) - 1)
            real = codes[where] == code[maybe]
            maybe, where = maybe[real], where[real]
            count = (first[where + 1] - first[where]).astype(np.int64)
            own = np.repeat(first[where].astype(np.int64), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append((np.repeat(maybe, count), item[own].astype(np.int64), offset[own].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def candidates(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, lowest diagonal, highest diagonal) where hits of an item in a row lie so close that they can be one place of it."""
        position, item, offset = self.hits(data)
        if not len(position):
            return iter(())
        row = np.searchsorted(off, position, "right") - 1
        diagonal = position - offset - off[row]
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal = row[order], item[order], diagonal[order]
        apart = np.ones(len(row), bool)
        apart[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > 2 * self.most[item[1:]])
        heads = np.flatnonzero(apart)
        return zip(row[heads].tolist(), item[heads].tolist(), diagonal[heads].tolist(), diagonal[np.append(heads[1:], len(row)) - 1].tolist())


SCHEMA = "doc_id bigint, item_id bigint, distance int, start bigint, end bigint"


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    pieces: Pieces = shared.value
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        for a, b in slices(col):
            data, off = normal_bytes(col.slice(a, b - a))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for row, item, low, high in pieces.candidates(data, off):
                text, most = pieces.texts[item], int(pieces.most[item])
                begin = max(0, low - most)
                hit = myers_find(text, data[off[row] + begin : min(off[row] + high + len(text) + most, off[row + 1])].tobytes(), most)
                if hit and ((row, item) not in best or hit[0] < best[row, item][0]):
                    best[row, item] = (hit[0], max(0, begin + hit[1] - len(text)), begin + hit[1])
            found = [(ids[a + row], int(i), *place) for (row, item), place in best.items() for i in pieces.ids[pieces.first[item] : pieces.first[item + 1]]]
            if found:
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])


def contaminated(docs: DataFrame, benchmark: DataFrame, error_bytes: int = ERROR_BYTES, min_item: int = MIN_ITEM_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, end): every pair of a document and an item that it holds, with the item's nearest place.

    distance is the smallest edit distance between the item and a part of the text, at most len(item) // error_bytes; end is where the
    first such part ends, and start lies len(item) before it (0 at least), in bytes of the text's normal form.

    Very long texts are searched whole. Of places that are equally near, the first counts; items of the same text are each given.
    Nulls and texts without words match nothing, as do items of fewer than min_item bytes in normal form and rows with a null
    doc_id or item_id. Repeated rows are matched one by one and give repeated rows. Empty tables give an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    passes = []
    for g in range(groups):
        own = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        table = own.toArrow().combine_chunks()  # group_bytes of text, about
        shared = spark.sparkContext.broadcast(Pieces(table["item_id"].to_numpy(), table["text"].combine_chunks(), error_bytes, min_item))
        passes.append(texts.mapInArrow(lambda it, shared=shared: _scan(it, shared), SCHEMA))
    return reduce(DataFrame.unionByName, passes)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_bytes: int = ERROR_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the documents that hold a benchmark item. Rows with a null doc_id or text stay; all columns do.

    The ids that go are stored and sent out up to broadcast_bytes, so that the texts stay where they are; beyond, they are joined.
    """
    gone = cut(contaminated(docs, benchmark, error_bytes).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(hinted(gone, broadcast_bytes), docs["doc_id"] == gone["__gone"], "left_anti")
