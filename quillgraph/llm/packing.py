"""Operator 10, best-fit packing with large-item matching.

Texts are cut into pieces of at most one bin. Pieces over a third of the capacity are large; a bin takes two of them at most. Large pieces
are matched greedily, the largest first, each with the largest partner that still fits; smaller pieces then go, in falling size, where
they leave the smallest gap. Pieces carry lengths only, so what is shuffled is a few bytes a document. Packing is sequential by
nature; it runs in groups of some ten thousand documents, taken by hash, each with thousands of bins, so that at most a few bins
a group are left part empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words in a bin.
CAPACITY = 2048
#: Documents packed together.
GROUP_DOCS = 16_384


class Gaps:
    """Open bins by their gap: the fullest bin that fits, in constant time for a bounded capacity."""

    def __init__(self, capacity: int):
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, gap: int, number: int) -> None:
        self.bins[gap].append(number)
        self.mask |= 1 << gap

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the smallest gap of at least size, the last opened of several, and that gap."""
        above = self.mask >> size
        if not above:
            return None
        gap = size + (above & -above).bit_length() - 1
        number = self.bins[gap].pop()
        if not self.bins[gap]:
            self.mask ^= 1 << gap
        return gap, number


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, given in falling order; sizes are from 1 to capacity."""
    out = [-1] * len(sizes)
    n_large = sum(3 * s > capacity for s in sizes)
    bins = 0
    gaps = Gaps(capacity)
    # Large pieces by size; each, from the largest, takes the largest unmatched one that fits beside it.
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in range(n_large - 1, -1, -1):
        waiting[sizes[i]].append(i)
        mask |= 1 << sizes[i]
    for i in range(n_large):
        if out[i] >= 0:
            continue
        waiting[sizes[i]].pop()  # i itself: equal sizes leave in order
        if not waiting[sizes[i]]:
            mask &= ~(1 << sizes[i])
        out[i], used = bins, sizes[i]
        fits = mask & ((1 << (capacity - used + 1)) - 1)
        if fits:
            size = fits.bit_length() - 1
            partner = waiting[size].pop()
            if not waiting[size]:
                mask &= ~(1 << size)
            out[partner] = bins
            used += size
        if used < capacity:
            gaps.add(capacity - used, bins)
        bins += 1
    for i in range(n_large, len(sizes)):
        hit = gaps.take(sizes[i])
        gap, number = hit if hit else (capacity, bins)
        bins += hit is None
        out[i] = number
        if gap > sizes[i]:
            gaps.add(gap - sizes[i], number)
    return out


SCHEMA = "bin string, used bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>"


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    group = table.column("g")[0].as_py()
    ids, words = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
    pieces = -(-words // capacity)
    doc = np.repeat(np.arange(len(ids)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    size = np.minimum(capacity, words[doc] - start)
    order = np.lexsort((start, ids[doc], -size))
    doc, start, size = doc[order], start[order], size[order]
    place = np.array(pack(size.tolist(), capacity), np.int64)
    order = np.argsort(place, kind="stable")
    doc, start, size, place = doc[order], start[order], size[order], place[order]
    offsets = pa.array(np.concatenate([np.flatnonzero(np.diff(place, prepend=-1)), [len(place)]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (ids[doc], start, size)]
    used = np.bincount(place, size).astype(np.int64)
    return pa.table([pa.array([f"{group}-{k}" for k in range(len(used))], pa.string()), pa.array(used), *lists], ["bin", "used", "doc_ids", "starts", "lengths"])


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(bin, used, doc_ids, starts, lengths): one row per bin, with its pieces as parallel lists.

    A piece is lengths[i] words of document doc_ids[i] from word starts[i] on; words are runs of characters without white space.
    A document longer than the capacity is cut into whole bins and a rest; every word of every document is in one bin.

    Documents are packed in groups of about group_docs, taken by a hash of doc_id; the number of groups follows the number of rows, so adding rows regroups
    all. Matching and best fit do not cross groups, which costs a few part-filled bins each.

    Null, empty and blank texts have no words and are in no bin, nor are rows with a null doc_id. Repeated rows are packed as often as they
    come. Ties go by doc_id and place. An empty table gives an empty result; other columns are not read.
    """
    words = F.size(F.filter(F.split(F.col("text"), r"\s+", -1), lambda w: w != "")).cast("bigint")
    lengths = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("n"))
    groups = max(1, docs.count() // group_docs)
    keyed = lengths.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return keyed.groupBy("g").applyInArrow(lambda t: _pack_group(t, capacity), SCHEMA)
