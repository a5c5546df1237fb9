"""Operator 8, SimHash near-dedup over vantage-point trees.

A document's fingerprint is 128 bits over its set of words. Two documents are near copies when the first 64 bits differ in at
most RADIUS places and all 128 in at most TOTAL. The search is exact. Random 64-bit words all lie about 32 from each other, so a
tree over whole fingerprints prunes nearly nothing; the first 64 bits are therefore cut into BLOCKS blocks, of which a near
pair must agree in one up to a distance of RADIUS // BLOCKS, and each block has its own vantage-point tree over the block's first bits. A node holds a vantage
point and a median distance; by the triangle inequality, a value whose distance is further than that from the median needs only one branch.
A leaf ends with the values that it holds and, by their distances, those that it reaches. Rows of a leaf are compared with the rows it reaches, in arrays, and a
pair is taken only by the first block that could find it, so it is counted once.

Fingerprints are cut into chunks by hash, and every two chunks meet in a task of their own, a tile, so that a task's memory stays the same at any size.
Trees are built from the counts of block values over all fingerprints, tables of fixed size.

For counts and groups, pairs are more than is needed: a tile gives one row for each fingerprint that it finds near others, with the number of documents there and
what joins the near rows, a forest, in place of all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.textkit import U64, Words, mix, signed, slices, text_column
from quillgraph.operators.components import connected_components
from quillgraph.storage import BROADCAST_BYTES, cut, hinted

#: Largest distance in the first 64 bits.
RADIUS = 11
#: Largest distance in all 128 bits.
TOTAL = 21
#: Blocks of the first 64 bits.
BLOCKS = 4
#: A leaf stops at about so many of a tile's rows, or at one value.
LEAF_ROWS = 32
#: Fingerprints in a chunk.
SHARD_ROWS = 1 << 18
#: Chunks of so many fingerprints are worth a task of their own, up to SPREAD chunks.
SPREAD_ROWS, SPREAD = 4096, 8
#: Links that a task holds before it joins them to a forest.
HELD_LINKS = 1 << 20

_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], U64)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per segment of hashes, the 64-bit word whose bits are set in more than half of the segment's hashes.

    Eight one-byte counters share a word, so segments are summed in runs of at most 255 hashes.
    """
    count = np.diff(first)
    used = np.flatnonzero(count)
    out = np.zeros(len(count), U64)
    if not len(used):
        return out
    runs = -(-count[used] // 255)
    owner = np.repeat(np.arange(len(used)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = first[used][owner] + 255 * nth
    heads = np.cumsum(runs) - runs
    view = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[view[:, byte]], begin).view(np.uint8).reshape(-1, 8)
        totals = np.add.reduceat(sums.astype(np.int64), heads, axis=0)
        out[used] |= np.packbits(2 * totals > count[used][:, None], axis=1, bitorder="little")[:, 0].astype(U64) << U64(8 * byte)
    return out


FINGERPRINT_SCHEMA = "doc_id bigint, f1 bigint, f2 bigint, n_words bigint"


def fingerprint(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first 64 bits, second 64 bits, distinct words) of each text of a slice."""
    words = Words(col)
    # One 64-bit key holds row and word, so that a plain sort finds the distinct words of each row.
    key = np.unique((words.row.astype(U64) << U64(44)) | (words.hash >> U64(20)))
    first = np.searchsorted(key, np.arange(words.rows + 1).astype(U64) << U64(44))
    word = mix(key & U64((1 << 44) - 1))
    return _majority(word, first), _majority(mix(word + U64(0xA0761D6478BD642F)), first), np.diff(first)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id"))
        for a, b in slices(col):
            for at in range(a, b, 1 << 18):
                to = min(b, at + (1 << 18))
                f1, f2, n = fingerprint(col.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at).cast(pa.int64()), signed(f1), signed(f2), pa.array(n.astype(np.int64))], ["doc_id", "f1", "f2", "n_words"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, n_words) of documents with a doc_id and at least one word."""
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_fingerprints, FINGERPRINT_SCHEMA).where("n_words > 0")


class VantageTree:
    """A vantage-point tree over the values of so many bits, flattened to tables.

    rank orders values by leaf; leaf i has the ranks from first[i] to first[i + 1] and reaches those of reach[i], its own included: all values within radius of one of its own.
    """

    def __init__(self, width: int, weight: np.ndarray, radius: int, leaf_rows: float, seed: int):
        self.radius, self.leaf_rows = radius, leaf_rows
        self._leaves: list[tuple[np.ndarray, np.ndarray]] = []
        self._rng = np.random.default_rng(seed)
        values = np.arange(1 << width)
        self._grow(values, values, weight.astype(float) + 1e-3)
        order = np.concatenate([own for own, _ in self._leaves])
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = values
        self.first = np.cumsum([0] + [len(own) for own, _ in self._leaves])
        self.reach = [np.sort(self.rank[reach]).astype(np.int32) for _, reach in self._leaves]
        del self._leaves, self._rng

    def _grow(self, own: np.ndarray, reach: np.ndarray, weight: np.ndarray) -> None:
        """own: values at home below this node; reach: values whose ball may overlap it."""
        if len(own) == 1 or weight[own].sum() <= self.leaf_rows:
            near = np.zeros(len(reach), bool)
            for v in own:
                near |= np.bitwise_count(reach ^ v) <= self.radius
            self._leaves.append((own, reach[near]))
            return
        best = None
        for vantage in self._rng.choice(own, min(4, len(own)), replace=False):
            below = np.cumsum(np.bincount(np.bitwise_count(own ^ vantage), weight[own]))
            median = int(np.argmin(np.abs(below[:-1] - below[-1] / 2)))  # values differ, so there are two distances
            off = abs(below[median] - below[-1] / 2)
            if best is None or off < best[0]:
                best = (off, vantage, median)
        _, vantage, median = best
        near, far = np.bitwise_count(own ^ vantage) <= median, np.bitwise_count(reach ^ vantage).astype(int)
        self._grow(own[near], reach[far - self.radius <= median], weight)
        self._grow(own[~near], reach[far + self.radius > median], weight)


def _blocks() -> list[tuple[int, int]]:
    """(shift, width) of the blocks of the first 64 bits."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block(f: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (f >> U64(shift)) & U64((1 << width) - 1)


def _spans(first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The positions first[r] to first[r + 1] of every rank r."""
    count = first[rank + 1] - first[rank]
    return np.repeat(first[rank] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _near(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, trees: list[VantageTree], bits: int, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of near rows i of left and j of right, each once; where right is None, of two rows of left. Each is a pair (f1, f2)."""
    blocks, slack = _blocks(), radius // BLOCKS
    for k, (tree, (shift, width)) in enumerate(zip(trees, blocks)):
        sides = []
        for f1, f2 in (left,) if right is None else (left, right):
            rank = tree.rank[_block(f1, shift + width - bits, bits).astype(np.int64)]
            order = np.argsort(rank, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=1 << bits))])
            sides.append((order, f1[order], f2[order], first))
        (left_order, left1, left2, left_first), (right_order, right1, right2, right_first) = sides[0], sides[-1]
        ends = left_first[tree.first]
        for leaf in np.flatnonzero(ends[1:] > ends[:-1]):
            lo, hi = ends[leaf], ends[leaf + 1]
            reach = tree.reach[leaf]
            met = _spans(right_first, reach[reach >= tree.first[leaf]] if right is None else reach)
            there = right1[met]
            for a in range(lo, hi, 64):
                here = left1[a : min(hi, a + 64), None]
                for b in range(0, len(met), 4096):
                    i, j = np.divmod(np.flatnonzero(np.bitwise_count(here ^ there[b : b + 4096]) <= radius), min(4096, len(met) - b))
                    if not len(i):
                        continue
                    i, j = i + a, met[j + b]
                    if right is None:
                        i, j = i[j > i], j[j > i]
                    other = left1[i] ^ right1[j]
                    far = np.bitwise_count(other).astype(np.int32) + np.bitwise_count(left2[i] ^ right2[j])
                    good = far <= total
                    for e, (s, w) in enumerate(blocks[: k + 1]):
                        close = np.bitwise_count(_block(other, s, w)) <= slack
                        good &= close if e == k else ~close
                    if good.any():
                        yield left_order[i[good]], right_order[j[good]], far[good]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(least row, row) for every row that pairs join with a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    later = np.flatnonzero(label != np.arange(n))
    return label[later], later


PAIR_SCHEMA = "doc_id_a bigint, doc_id_b bigint, hamming int"
FOUND_SCHEMA = "f1 bigint, f2 bigint, n_links bigint, doc_id bigint, least bigint"


def _met(table: pa.Table, trees: list[VantageTree], bits: int, radius: int, total: int) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A tile's rows by doc_id, and what _near finds between its two chunks, or within its only one."""
    table = table.sort_by("doc_id")
    f1, f2 = (table.column(c).to_numpy().view(U64) for c in ("f1", "f2"))
    i, j, chunk = (table.column(c).to_numpy() for c in ("i", "j", "chunk"))
    if i[0] == j[0]:
        return table, _near((f1, f2), None, trees, bits, radius, total)
    one, two = np.flatnonzero(chunk == i[0]), np.flatnonzero(chunk == j[0])
    return table, ((one[x], two[y], far) for x, y, far in _near((f1[one], f2[one]), (f1[two], f2[two]), trees, bits, radius, total))


def _match(table: pa.Table, *by) -> pa.Table:
    """The near pairs of a tile."""
    table, met = _met(table, *by)
    none = np.zeros(0, np.int64)
    i, j, far = (np.concatenate(x) for x in zip((none, none, none.astype(np.int32)), *met))
    ids = table.column("doc_id").to_numpy()
    return pa.table({"doc_id_a": np.minimum(ids[i], ids[j]), "doc_id_b": np.maximum(ids[i], ids[j]), "hamming": far})


def _join(table: pa.Table, *by) -> pa.Table:
    """Of the rows that a tile finds near others: how many documents those are, and the least doc_id among those it joins."""
    table, met = _met(table, *by)
    n, size = table.num_rows, table.column("n").to_numpy()
    links, least, held, many = np.zeros(n, np.int64), np.arange(n), [], 0

    def joined() -> list[tuple[np.ndarray, np.ndarray]]:
        return [_forest(*(np.concatenate(x) for x in zip(*held)), n)] if held else []

    for i, j, _ in met:
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        held.append((i, j))
        many += len(i)
        if many > HELD_LINKS:
            held, many = joined(), 0
    for root, row in joined():
        least[row] = root
    at = np.flatnonzero(links)
    ids = table.column("doc_id").to_numpy()
    return pa.table({"f1": table.column("f1").take(pa.array(at)), "f2": table.column("f2").take(pa.array(at)), "n_links": links[at], "doc_id": ids[at], "least": ids[least[at]]})


def _tiles(prints: DataFrame, radius: int, total: int, shard_rows: int, each, schema: str) -> DataFrame:
    """each over all tiles of prints, which are (doc_id, f1, f2, n), computed already and of different fingerprints."""
    rows = prints.count()
    chunks = max(1, -(-rows // shard_rows), min(SPREAD, rows // SPREAD_ROWS))
    blocks = _blocks()
    own = max(1, rows // chunks)
    bits = min(max(1, (own // LEAF_ROWS).bit_length()), *(w for _, w in blocks))
    shifts = [s + w - bits for s, w in blocks]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("f1", s).bitwiseAND(F.lit((1 << bits) - 1)).alias("v")) for k, s in enumerate(shifts)))).alias("x")
    weights = np.zeros((BLOCKS, 1 << bits))
    for k, v, n in prints.select(values).groupBy("x.k", "x.v").count().collect():  # at most 2**bits rows a block
        weights[k, v] = n
    trees = [VantageTree(bits, weight / chunks, radius // BLOCKS, LEAF_ROWS, k) for k, weight in enumerate(weights)]
    shared = prints.sparkSession.sparkContext.broadcast(trees)
    chunk = F.pmod(F.xxhash64("f1", "f2"), F.lit(chunks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("other")
    routed = prints.select("doc_id", "f1", "f2", "n", chunk.alias("chunk"), other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other")
    # A number of partitions of its own, as few bytes of rows are much to compare.
    routed = routed.repartition(min(chunks * (chunks + 1) // 2, 512), "i", "j")
    return routed.groupBy("i", "j").applyInArrow(lambda t: each(t, shared.value, bits, radius, total), schema)


def near_pairs(prints: DataFrame, radius: int = RADIUS, total: int = TOTAL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id_a, doc_id_b, hamming) of all pairs of rows (doc_id, f1, f2) within the bounds, a < b, each once.

    Rows are taken to have different doc_id and fingerprints. Pairs may be as many as the square of the rows, and a task holds those of its tile.
    """
    return _tiles(prints.withColumn("n", F.lit(1)), radius, total, shard_rows, _match, PAIR_SCHEMA)


def near_links(prints: DataFrame, radius: int = RADIUS, total: int = TOTAL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id_a, doc_id_b): links, fewer than near_pairs gives, whose connected components are those of near_pairs. Links may come again."""
    found = _tiles(prints.withColumn("n", F.lit(1)), radius, total, shard_rows, _join, FOUND_SCHEMA)
    return found.where("least <> doc_id").select(F.col("least").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, f1, f2) of documents; and the classes of equal fingerprints with the smallest doc_id and the number of documents, (doc_id, f1, f2, n)."""
    prints = cut(fingerprints(docs).select("doc_id", "f1", "f2").distinct())
    return prints, cut(prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "f1", "f2", "n"))


def _groups(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, component) of the documents that have copies or near copies."""
    first = classes.where("n > 1").select(F.col("doc_id").alias("least"), "f1", "f2")
    same = prints.join(first, ["f1", "f2"]).select("least", "doc_id")
    return connected_components(same.union(found.select("least", "doc_id")).where("least <> doc_id"), "least", "doc_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, total: int = TOTAL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document, with its group of near copies and the number of other documents within the bounds.

    Documents are near when their fingerprints are within the bounds, however few their words; equal fingerprints are at distance 0. n_links counts every
    such document, copies included, and nothing is capped. class_id is the smallest doc_id that links lead to, its own where it has none.

    A null doc_id takes no part; neither does a null, empty or wordless text. Very long texts are read whole. Repeated rows with one doc_id and text count
    once; a doc_id with different texts has one row, with the links of each text added up. An empty table gives
    an empty result; other columns are not read.
    """
    prints, classes = _classes(docs)
    found = cut(_tiles(classes, radius, total, shard_rows, _join, FOUND_SCHEMA))
    groups = _groups(prints, classes, found)
    links = found.groupBy("f1", "f2").agg(F.sum("n_links").alias("more"))
    sizes = classes.select("f1", "f2", "n").join(links, ["f1", "f2"], "left").select("f1", "f2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")).where("n_links > 0")
    each = prints.join(sizes, ["f1", "f2"], "left").groupBy("doc_id").agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))
    return each.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, total: int = TOTAL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with one document of each near-copy group, the one with the smallest doc_id.

    Groups are the classes of near_duplicates. Rows that take no part there stay, and so do all columns;
    rows repeated with one doc_id are one document and stay or go together. The ids that go are sent out up to broadcast_bytes and joined beyond.
    """
    prints, classes = _classes(docs)
    groups = _groups(prints, classes, _tiles(classes, radius, total, SHARD_ROWS, _join, FOUND_SCHEMA))
    gone = cut(groups.where("node <> component").select(F.col("node").alias("__gone")))
    return docs.join(hinted(gone, broadcast_bytes), docs["doc_id"] == gone["__gone"], "left_anti")
