"""Operator 3, line dedup by a segment-partition edit join.

Two lines are alike when their edit distance is at most TAU, or when they differ in one stretch, of at most one character in STRETCH_CHARS
of the shorter line on either side; several changes further apart than that are not looked for. For the distance, a line is cut into TAU + 1 even segments; if
another line lies within TAU edits, one of these segments occurs in it unchanged, at a place that the two lengths
confine to a few positions. So each line writes TAU + 1 index rows and a fixed number of probe rows (12 for TAU = 2),
and bringing together equal (segment number, indexed length, segment content) finds every candidate: one shuffle by
their hash, a sort, and a merge over the sorted runs. Rows carry a 64-bit parity sketch of the line's character pairs: an edit flips
few of its bits, so most false candidates end inside the merge, without their texts. The rest are verified with a banded bit-parallel edit distance.

A line that differs in one stretch keeps nearly half of its characters at its start or its end, so one key for each, of a length that goes by
classes of line lengths, is in the same shuffle. Their rows carry, in place of the sketch, small hashes of SECTIONS starts and as many ends of growing length: lines
that differ in one stretch share most of them, so most lines with changes apart from each other end inside the merge as well. The rest are verified by their common start and end.

Alike lines are linked transitively; of each group the first occurrence, by (doc_id, line number), stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillgraph.llm.textkit import U64, Lines, Prefix, mix, signed, slices, text_column, unused
from quillgraph.operators.components import connected_components
from quillgraph.storage import BROADCAST_BYTES, cut, hinted, stored

#: Largest edit distance, in characters, between lines that count as the same.
TAU = 2
#: One stretch may differ by a character for so many of the shorter line.
STRETCH_CHARS = 16
#: Starts, and ends, of a line that the rows of its half keys tell apart, in two bits each; a section is a STRETCH_CHARS-th of the class's least length.
SECTIONS = 15
#: Shorter lines are left alone: at so few characters TAU edits make another sentence.
MIN_CHARS = 20
#: Largest set of line keys sent to every executor; beyond it, lines are joined with the keys instead.
BROADCAST_KEYS = 4_000_000


_BIT = U64(1) << np.arange(64, dtype=U64)


def _flips(tau: int) -> int:
    """Sketch bits that tau edits can flip: an edit removes up to two character pairs and adds up to two."""
    return 4 * tau


def _eligible(lines: Lines, min_chars: int) -> np.ndarray:
    return np.flatnonzero(lines.length >= min_chars)


def _sketch(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR over the line's adjacent character pairs of one bit each, chosen by hash."""
    pair = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(26)
    bits = np.zeros(max(1, len(codes)), U64)
    if len(pair):
        np.bitwise_xor.accumulate(_BIT[pair], out=bits[1:])
    return bits[end - 1] ^ bits[start]


def _segments(length: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the tau + 1 even segments, the longer ones last."""
    size, longer = length // (tau + 1), length % (tau + 1)
    at = np.zeros_like(length)
    for i in range(tau + 1):
        own = size + (i >= tau + 1 - longer)
        yield at, own
        at = at + own


def _key(content: np.ndarray, i: int, length: np.ndarray) -> np.ndarray:
    return mix(content ^ (length.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(i + 1) * U64(0x165667B19E3779F9)))


def _index_rows(prefix: Prefix, start: np.ndarray, length: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of every index row."""
    every = np.arange(len(start))
    for i, (at, size) in enumerate(_segments(length, tau)):
        yield every, _key(prefix.of(start + at, start + at + size), i, length)


def _probe_rows(prefix: Prefix, start: np.ndarray, length: np.ndarray, tau: int, min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, key) of every probe row: for each indexed length up to the line's own, the substrings that may equal a segment."""
    for delta in range(tau + 1):
        indexed = length - delta
        fits = indexed >= min_chars
        for i, (at, size) in enumerate(_segments(indexed, tau)):
            for shift in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1):
                p = at + shift
                rows = np.flatnonzero(fits & (p >= 0) & (p + size <= length))
                s = start[rows] + p[rows]
                yield rows, _key(prefix.of(s, s + size[rows]), i, indexed[rows])


#: Least lengths of the classes of lines, each about a quarter over the one before.
_CLASSES = np.unique((STRETCH_CHARS * 1.25 ** np.arange(90)).astype(np.int64))


def _sections(prefix: Prefix, start: np.ndarray, length: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Two bits of a hash of each of a line's starts of 1 to SECTIONS sections, then of its ends; the top four bits are the sections by which it is longer than least."""
    size, end = least // STRETCH_CHARS, start + length
    out = np.minimum((length - least) * STRETCH_CHARS // least, 15).astype(U64) << U64(60)
    for k in range(1, SECTIONS + 1):
        out |= (prefix.of(start, start + k * size) & U64(3)) << U64(2 * (k - 1))
        out |= (prefix.of(end - k * size, end) & U64(3)) << U64(2 * (SECTIONS + k - 1))
    return out


def _one_change(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether lines of these sections may differ in one stretch only.

    Such lines have n - n / STRETCH_CHARS characters or more in common at start and end, where n is the longer one's length. In sections that is 15 / 16 of n, less the
    part of one that may be left over on either side. Where all starts or all ends are the same, what lies beyond them isn't known, and the pair passes.
    """
    different = a ^ b
    low, high = (((different >> U64(s)) & U64((1 << 30) - 1) | U64(1 << 30)).astype(np.uint32) for s in (0, 30))
    starts, ends = (np.bitwise_count((x & -x) - np.uint32(1)) // 2 for x in (low, high))  # zero bits before the first one
    longer = np.maximum(a >> U64(60), b >> U64(60)).astype(np.int64)
    return (starts + ends > SECTIONS - 2 + SECTIONS * longer // STRETCH_CHARS) | (starts == SECTIONS) | (ends == SECTIONS)


def _half_rows(prefix: Prefix, start: np.ndarray, length: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, U64, np.ndarray]]:
    """(line, key, probe bit, sections) of starts and ends; probe rows also in the class below, where a shorter line may stand."""
    own = np.searchsorted(_CLASSES, length, "right") - 1
    low = _CLASSES[np.maximum(own, 0)]
    longer = np.flatnonzero((own > 0) & (low - 1 + (low - 1) // STRETCH_CHARS >= length))
    every = np.flatnonzero(length // STRETCH_CHARS > tau)
    for rows, below, probes in ((every, 0, (U64(0), U64(1))), (longer, 1, (U64(1),))):
        least = _CLASSES[own[rows] - below]
        size = least * (STRETCH_CHARS - 1) // (2 * STRETCH_CHARS)
        sections = _sections(prefix, start[rows], length[rows], least)
        for half, at in ((0, start[rows]), (1, start[rows] + length[rows] - size)):
            key = _key(prefix.of(at, at + size), 9 + half, least)
            for probe in probes:
                yield rows, key, probe, sections


#: The lowest bit of a key marks those of halves.
_HALF = U64(1)
KEY_SCHEMA = "key bigint, line bigint, sketch bigint"


def _names(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of lines: hashes whose lowest bit is free, to tell probe rows from index rows."""
    return prefix.of(start, end) & ~U64(1)


def _keys(batches: Iterator[pa.RecordBatch], tau: int, min_chars: int) -> Iterator[pa.RecordBatch]:
    """Index and probe rows of all lines, each line once a batch; the lowest bit of line marks probe rows."""
    for batch in batches:
        col = text_column(batch)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in slices(col):
            lines = Lines(col.slice(a, b - a))
            at = _eligible(lines, min_chars)
            if not len(at):
                continue
            start, end, length = lines.start[at], lines.end[at], lines.length[at]
            prefix = Prefix(lines.coded())
            name, sketch = _names(prefix, start, end), _sketch(lines.codes, start, end)
            name, once = np.unique(name, return_index=True)
            start, length, sketch = start[once], length[once], sketch[once]
            for probe, rows in ((U64(0), _index_rows(prefix, start, length, tau)), (U64(1), _probe_rows(prefix, start, length, tau, min_chars))):
                parts += [(key & ~_HALF, name[line] | probe, sketch[line]) for line, key in rows]
            parts += [(key | _HALF, name[line] | probe, sections) for line, key, probe, sections in _half_rows(prefix, start, length, tau)]
        if parts:
            key, name, sketch = (np.concatenate(x) for x in zip(*parts))
            order = np.unique(mix(key) ^ name, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([signed(key[order]), signed(name[order]), signed(sketch[order])], ["key", "line", "sketch"])


def _met(key: np.ndarray, line: np.ndarray, sketch: np.ndarray, flips: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of whole runs of equal keys: every index row with every probe row of another line, if their sketches are near or they may differ in one stretch."""

    def runs(key: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))

    if not len(key):
        return
    heads, name = runs(key), line & ~U64(1)
    size = np.diff(np.append(heads, len(key)))
    probes = np.add.reduceat((line & U64(1)).astype(np.int64), heads)
    live = (np.minimum.reduceat(name, heads) != np.maximum.reduceat(name, heads)) & (probes > 0) & (probes < size)
    at = np.flatnonzero(np.repeat(live, size))
    if not len(at):
        return
    at = at[np.sort(np.unique(mix(key[at]) ^ line[at], return_index=True)[1])]  # a line comes once a batch, not once in all
    key, line, sketch = key[at], line[at], sketch[at]
    heads = runs(key)
    run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
    order = np.lexsort((line & U64(1), run))
    line, sketch, run = line[order], sketch[order], run[order]
    half = (key & _HALF) > 0  # alike in all rows of a run
    probe = np.flatnonzero(line & U64(1))
    n_index = np.bincount(run[(line & U64(1)) == 0], minlength=len(heads))
    count = n_index[run[probe]]
    before = np.cumsum(count) - count
    for lo in range(0, len(probe), 1 << 14):
        own = slice(lo, lo + (1 << 14))
        p = np.repeat(probe[own], count[own])
        i = np.repeat(heads[run[probe[own]]] - (before[own] - before[lo]), count[own]) + np.arange(len(p))
        a, b = line[p] & ~U64(1), line[i]
        good = np.where(half[p], _one_change(sketch[p], sketch[i]), np.bitwise_count(sketch[p] ^ sketch[i]) <= flips) & (a != b)
        a, b = a[good].view(np.int64), b[good].view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch], flips: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows sorted by key; the last run of a batch waits for the next."""
    held = [np.zeros(0, U64)] * 3
    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy().view(U64)]) for h, c in zip(held, ("key", "line", "sketch"))]
        other = np.flatnonzero(rows[0] != rows[0][-1]) if len(rows[0]) else []
        cut_at = int(other[-1]) + 1 if len(other) else 0
        held = [r[cut_at:] for r in rows]
        yield from _met(*(r[:cut_at] for r in rows), flips)
    yield from _met(*held, flips)


def _places(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id"))
        for a, b in slices(col):
            lines = Lines(col.slice(a, b - a))
            at = _eligible(lines, min_chars)
            if len(at):
                name = _names(Prefix(lines.coded()), lines.start[at], lines.end[at])
                yield pa.RecordBatch.from_arrays(
                    [signed(name), ids.take(pa.array(lines.row[at] + a)).cast(pa.int64()), pa.array(lines.number[at].astype(np.int32))], ["line", "doc_id", "line_no"]
                )


def _texts(batches: Iterator[pa.RecordBatch], min_chars: int, wanted) -> Iterator[pa.RecordBatch]:
    """(line, text) of the lines whose keys are wanted; of all eligible lines where wanted is None. Once each per batch."""
    keys = None if wanted is None else wanted.value
    for batch in batches:
        col = text_column(batch)
        for a, b in slices(col):
            lines = Lines(col.slice(a, b - a))
            at = _eligible(lines, min_chars)
            if not len(at):
                continue
            name, once = np.unique(_names(Prefix(lines.coded()), lines.start[at], lines.end[at]), return_index=True)
            if keys is not None:
                if not len(keys):
                    continue
                found = np.minimum(np.searchsorted(keys, name), len(keys) - 1)
                hit = keys[found] == name
                name, once = name[hit], once[hit]
            if len(name):
                yield pa.RecordBatch.from_arrays([signed(name), pa.array([lines.text(int(at[i])) for i in once])], ["line", "text"])


def banded_distance(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, tau: int) -> np.ndarray:
    """Edit distances of the rows of a (lengths m) and b (lengths n), |m - n| <= tau: exact up to tau, over tau beyond.

    Hyyrö's banded bit-parallel recurrence, for all pairs at once: a word holds the vertical differences of the 2 * tau + 1
    cells around the diagonal and slides down one row with each character of b. The score follows the band's lowest
    diagonal until it meets the last row of a, and that row from there on. Padding in a equals nothing in b.
    """
    width = 2 * tau + 1
    full, top, one = U64((1 << width) - 1), U64(1 << (width - 1)), U64(1)
    plus = np.full(len(a), ((1 << (tau + 1)) - 1) << tau, U64)
    minus = np.zeros(len(a), U64)
    score = np.minimum(m, tau).astype(np.int64)
    padded = np.full((len(a), tau + a.shape[1] + b.shape[1] + width), -2, np.int64)
    padded[:, tau : tau + a.shape[1]] = a
    for j in range(1, b.shape[1] + 1):
        equal = np.zeros(len(a), U64)
        for r in range(width):
            equal |= (padded[:, j + r - 1] == b[:, j - 1]).astype(U64) << U64(r)
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        right_up = minus | (~(zero | plus) & full)
        right_down = zero & plus
        below = width - 1 - (j + tau - m)
        bit = np.clip(below, 0, width - 1).astype(U64)
        across = ((right_up >> bit) & one).astype(np.int64) - ((right_down >> bit) & one).astype(np.int64)
        step = np.where(j <= m - tau, (zero & top) == 0, across)
        score += np.where((j <= n) & (below >= 0), step, 0)
        slid = zero >> one
        plus = right_down | (~(slid | right_up) & full)
        minus = slid & right_up
    return score


VERIFIED_SCHEMA = "a bigint, b bigint"


def _verify(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            left, right = part.column("text_a").to_pylist(), part.column("text_b").to_pylist()
            good = one_stretch(left, right)
            rest = np.flatnonzero(~good)
            good[rest] = within([left[i] for i in rest], [right[i] for i in rest], tau)
            yield part.select(["a", "b"]).filter(pa.array(good))


def _trimmed(x: str, y: str) -> tuple[str, str]:
    """x and y without their common prefix and suffix, which never change the distance."""
    lo, n = 0, min(len(x), len(y))
    step = n
    while step:
        if x[lo : lo + step] == y[lo : lo + step] and lo + step <= n:
            lo += step
        step = min(step // 2, n - lo)
    x, y = x[lo:], y[lo:]
    hi, n = 0, min(len(x), len(y))
    step = n
    while step:
        if hi + step <= n and x[len(x) - hi - step : len(x) - hi] == y[len(y) - hi - step : len(y) - hi]:
            hi += step
        step = min(step // 2, n - hi)
    return x[: len(x) - hi], y[: len(y) - hi]


def one_stretch(left: list[str], right: list[str]) -> np.ndarray:
    """Whether each pair differs in one stretch only, on either side at most a character for STRETCH_CHARS of the shorter."""
    good = np.zeros(len(left), bool)
    for k, (x, y) in enumerate(zip(left, right)):
        most = min(len(x), len(y)) // STRETCH_CHARS
        if abs(len(x) - len(y)) > most:
            continue
        x, y = _trimmed(x, y)  # steps are halved and rounded down, so some equal characters may be left
        n = min(len(x), len(y))
        lo = next((i for i in range(n) if x[i] != y[i]), n)
        hi = next((i for i in range(n - lo) if x[-1 - i] != y[-1 - i]), n - lo)
        good[k] = max(len(x), len(y)) - lo - hi <= most
    return good


def within(left: list[str], right: list[str], tau: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most tau."""
    good = np.zeros(len(left), bool)
    cores = [_trimmed(x, y) for x, y in zip(left, right)]
    todo = []
    for i, (x, y) in enumerate(cores):
        if abs(len(x) - len(y)) > tau:
            continue
        if min(len(x), len(y)) == 0:
            good[i] = True
        else:
            todo.append(i)
    todo.sort(key=lambda i: len(cores[i][1]))
    for at in range(0, len(todo), 512):
        rows = todo[at : at + 512]
        m = np.array([len(cores[i][0]) for i in rows])
        n = np.array([len(cores[i][1]) for i in rows])
        a, b = np.full((len(rows), m.max()), -2, np.int64), np.full((len(rows), n.max()), -1, np.int64)
        for k, i in enumerate(rows):
            a[k, : m[k]] = np.frombuffer(cores[i][0].encode("utf-32-le", "surrogatepass"), np.uint32)
            b[k, : n[k]] = np.frombuffer(cores[i][1].encode("utf-32-le", "surrogatepass"), np.uint32)
        good[rows] = banded_distance(a, b, m, n, tau) <= tau
    return good


def _usable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def similar_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(a, b): keys of all pairs of different lines of at least min_chars characters within tau edits or with one stretch changed, a < b, each once."""
    texts = _usable(docs).select("text")

    rows = texts.mapInArrow(lambda it: _keys(it, tau, min_chars), KEY_SCHEMA)
    # One shuffle by key and a sort bring an indexed segment and its probes together; nearly all runs end there.
    candidates = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _meet(it, _flips(tau)), VERIFIED_SCHEMA).distinct())
    keys = candidates.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    n = keys.count()
    if n <= broadcast_keys:
        wanted = np.sort(keys.toArrow()["line"].to_numpy().view(U64)) if n else np.zeros(0, U64)
        shared = docs.sparkSession.sparkContext.broadcast(wanted)
        text = texts.mapInArrow(lambda it: _texts(it, min_chars, shared), "line bigint, text string")
    else:
        text = texts.mapInArrow(lambda it: _texts(it, min_chars, None), "line bigint, text string").join(keys, "line", "left_semi")
    text = text.dropDuplicates(["line"])
    both = candidates.join(text.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a").join(text.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInArrow(lambda it: _verify(it, tau), VERIFIED_SCHEMA)


def duplicate_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no): every line that repeats an earlier one, with the first of its group.

    Lines are split at newlines and compared as they are, in characters; those under min_chars characters never take part,
    and neither do rows whose doc_id or text is null. Very long lines and texts are compared whole. Within a document, lines are numbered from 0. Groups are
    transitive; the occurrence with the smallest (doc_id, line_no) is kept, and of repeated rows with one doc_id only
    the place counts, so they lose the same lines and are given once. An empty table gives an empty result; other columns are not read.

    The places of lines are stored once. Their firsts are a partial aggregate, so a line of which the corpus is full meets in no
    single task; what repeats is sent to the places up to broadcast_bytes, and joined beyond.
    """
    places = stored(_usable(docs).mapInArrow(lambda it: _places(it, min_chars), "line bigint, doc_id bigint, line_no int"), "places")
    groups = connected_components(similar_lines(docs, tau, min_chars, broadcast_keys), "a", "b", broadcast_bytes).select(F.col("node").alias("line"), F.col("component").alias("group"))
    place = F.struct("doc_id", "line_no")
    lines = places.groupBy("line").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = cut(lines.join(hinted(cut(groups), broadcast_bytes), "line", "left").where("first <> last OR group IS NOT NULL").select("line", F.coalesce("group", "line").alias("group"), "first"))
    firsts = cut(repeated.groupBy("group").agg(F.min("first").alias("kept")))
    kept = cut(repeated.join(hinted(firsts, broadcast_bytes), "group").select("line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")))
    out = places.join(hinted(kept, broadcast_bytes), "line").where("doc_id <> kept_doc_id OR line_no <> kept_line_no")
    return out.select("doc_id", "line_no", "kept_doc_id", "kept_line_no").distinct()


def drop_duplicate_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without their repeated lines, n_chars (where docs has it) renewed.

    Documents that lose every non-blank line go; all others stay, with the remaining lines in order, also those with a
    null or empty text or a null doc_id. Other columns pass through. The lines that go, by document, are sent out up to broadcast_bytes and joined beyond.
    """
    gone, key = unused(docs, "gone"), unused(docs, "key")
    drop = cut(duplicate_lines(docs, tau, min_chars, broadcast_bytes=broadcast_bytes).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(gone)))
    joined = docs.join(hinted(drop, broadcast_bytes), docs["doc_id"] == drop[key], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    hit = F.col(gone).isNotNull()
    out = joined.withColumn("text", F.when(hit, kept).otherwise(F.col("text"))).where(~hit | (F.trim(F.translate("text", "\n", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
