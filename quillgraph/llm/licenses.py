"""Operator 2, licence scans by diagonal voting.

Every run of K words (fewer for short templates) of every document is hashed, and Spark joins the hashes with the positions of the same hashes in the licence
templates. A match at document position p and template position t votes for the diagonal p - t. Votes are aggregated by diagonal;
neighbouring diagonals, which inserted or missing words bring about, are merged into one span. An error spoils at most as many runs as a
run has words, so a place within the allowed errors has a number of votes that follows from them; spans with so many are verified against
the text by word edit distance, and no place within the allowed errors is lost before.

The templates are a few thousand positions and are broadcast while they number at most BROADCAST_ROWS. Of the hashes, only matches
leave the join, so the votes that are shuffled follow the licences found, not the text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph.llm.license_templates import TEMPLATES
from quillgraph.llm.textkit import Words, signed, slices, text_column, word_hashes
from quillgraph.storage import cut

#: Words in a hashed run, at most.
K = 3
#: Diagonals this close are one alignment, as are those that the allowed errors can part.
GAP = 4
#: Largest share of a template's words that may be in error.
MAX_ERROR = 0.2
BROADCAST_ROWS = 1_000_000
#: Largest number of candidate spans that is sent to every executor for verification; more are joined by doc_id.
BROADCAST_SPANS = 500_000


def run_votes(n_words: int, most: int, k: int = K) -> tuple[int, int]:
    """Words in a run, k at most, and the votes that a place with at most so many errors has: the longest run that leaves one."""
    for size in range(min(k, n_words), 0, -1):
        votes = n_words - size + 1 - size * most
        if votes > 0:
            return size, votes
    return 1, 1


def _grams(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_numpy()
        for a, b in slices(col):
            words = Words(col.slice(a, b - a))
            for size in sizes:
                gram, at = words.grams(size)
                if not len(at):
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(ids[words.row[at] + a]), pa.array(words.position[at].astype(np.int32)), signed(gram)], ["doc_id", "position", "gram"])


def template_grams(spark: SparkSession, templates: dict[str, str], most: dict[str, int], k: int) -> DataFrame:
    """(gram, template, place, least, gap, n_words): least votes of a span, and the largest gap between its diagonals."""
    rows = []
    for name, text in templates.items():
        words = Words(pa.array([text]))
        size, least = run_votes(len(words.hash), most[name], k)
        grams, at = words.grams(size)
        rows += [(int(g), name, int(p), least, max(GAP, most[name]), len(words.hash)) for g, p in zip(grams.view(np.int64), at)]
    return spark.createDataFrame(rows, "gram bigint, template string, place int, least int, gap int, n_words int")


def _start(item: tuple, text: list, errors: int) -> int:
    """Where the shortest end part of text begins that lies errors from item, the least of any end part."""
    column = list(range(len(item) + 1))
    for n, c in enumerate([None, *reversed(text[-len(item) - errors :])]):
        if n:
            new = [n]
            for i, x in enumerate(reversed(item), 1):
                new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (x != c)))
            column = new
        if column[-1] == errors:
            break
    return len(text) - n


def find_all(item: tuple, text: list, most: int) -> list[tuple[int, int]]:
    """(distance, end) of places within most errors that share no words, in order: of overlapping ones the nearest, the first of several.

    Myers' algorithm from left to right. From the first place within most errors, nearer ones that overlap it take its place;
    what is left before such a one is searched again, and the search goes on behind it.
    """
    n = len(item)
    at: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    found: list[tuple[int, int]] = []
    begin = 0
    while begin < len(text):
        plus, minus, score = full, 0, n
        best, end, first, stop = most + 1, -1, -1, len(text)
        j = begin
        while j < stop:
            eq = at.get(text[j], 0)
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
            j += 1
            if score < best and (end < 0 or j - n + score < end or begin + _start(item, text[begin:j], score) < end):
                first = j if end < 0 else first
                best, end, stop = score, j, min(len(text), j + n + most)
                if not score:
                    break
        if end < 0:
            break
        if first <= end - n + best:
            start = begin + _start(item, text[begin:end], best)
            found += [(d, begin + e) for d, e in find_all(item, text[begin:start], most)]
        found.append((best, end))
        begin = end
    return found


def _regions(spans: list[dict], n: int) -> Iterator[tuple[str, int, int]]:
    """(template, low, high) in a text of n words, regions of one template that meet made one."""
    held: tuple[str, int, int] | None = None
    for name, low, high in sorted((s["template"], max(0, s["low"]), min(n, s["high"])) for s in spans):
        if held and held[0] == name and low <= held[2]:
            held = (name, held[1], max(held[2], high))
            continue
        if held:
            yield held
        held = (name, low, high)
    if held:
        yield held


def _checked(batches: Iterator[pa.RecordBatch], words_of: dict[str, tuple], most: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Verified spans of rows (doc_id, text, spans)."""
    for batch in batches:
        col, ids, spans = text_column(batch), batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist()
        found = []
        for a, b in slices(col):
            words = Words(col.slice(a, b - a))
            for row in range(a, b):
                own = words.hash[words.first[row - a] : words.first[row - a + 1]].tolist()
                for name, lo, hi in _regions(spans[row], len(own)):
                    for errors, end in find_all(words_of[name], own[lo:hi], most[name]):
                        found.append((ids[row], name, max(0, lo + end - len(words_of[name])), lo + end, errors))
        if found:
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "template", "start", "end", "errors"])


def license_spans(
    docs: DataFrame, templates: dict[str, str] | None = None, k: int = K, max_error: float = MAX_ERROR, broadcast_rows: int = BROADCAST_ROWS, broadcast_spans: int = BROADCAST_SPANS
) -> DataFrame:
    """(doc_id, template, start, end, errors): the licence texts that documents hold, by word position.

    Words are lower-case runs of letters and digits, numbered from 0. errors is the word edit distance between the
    template and the part of the text found, at most max_error of the template's words; end is where that part ends and start
    lies the template's length before it. All occurrences that share no words are found; of those that overlap, the nearest, the first of several.

    Very long texts are read whole; a place that is as near to two templates is given for both. The templates are sent out up to broadcast_rows words and the
    candidate spans up to broadcast_spans; beyond, either is joined.
    Nulls, empty texts and rows with a null doc_id give nothing, as do templates without words.
    Repeated rows give one result. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    words_of = {name: tuple(word_hashes(text).tolist()) for name, text in templates.items()}
    most = {name: int(max_error * len(w)) for name, w in words_of.items()}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    places = template_grams(spark, templates, most, k)
    sizes = sorted({run_votes(len(w), most[name], k)[0] for name, w in words_of.items()})
    small = sum(map(len, words_of.values())) <= broadcast_rows
    matches = texts.mapInArrow(lambda it: _grams(it, sizes), "doc_id bigint, position int, gram bigint").join(F.broadcast(places) if small else places, "gram")
    votes = matches.groupBy("doc_id", "template", (F.col("position") - F.col("place")).alias("diagonal"), "least", "gap", "n_words").agg(F.collect_set("place").alias("places"))
    by = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= F.col("gap"), 0).otherwise(1)
    spans = (
        votes.withColumn("apart", apart)
        .withColumn("span", F.sum("apart").over(by))
        .groupBy("doc_id", "template", "span", "least", "gap", "n_words")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"))
        .where(F.col("votes") >= F.col("least"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("template", (F.col("first") - F.col("gap")).alias("low"), (F.col("last") + F.col("n_words") + F.col("gap")).alias("high"))).alias("spans"))
    )
    spans = cut(spans)
    few = spans.count() <= broadcast_spans
    held = texts.join(F.broadcast(spans) if few else spans, "doc_id")
    return held.mapInArrow(lambda it: _checked(it, words_of, most), "doc_id bigint, template string, start int, end int, errors int").distinct()
