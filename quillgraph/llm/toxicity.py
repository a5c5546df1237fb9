"""Operator 4, toxic passages as maximum-scoring segments.

Training counts, for every token, the documents that hold it: all, those labelled toxic and those labelled clean. A token's score is its
log-odds ratio between toxic and clean documents under a Dirichlet prior of the corpus frequencies; tokens whose log-odds is not
significant score a constant drift below zero, as does everything unseen. A linear scan (Ruzzo and Tompa) then gives all maximal-scoring
segments of a document, and extreme-value statistics (Karlin and Altschul) turn a segment's score into the number of such segments that
clean text of that length would show by chance. The segments' significance is aggregated into one value a document.

Only tokens with a positive score matter one by one, since all others cost the drift: a document is its hits and its length. So the
scan over the corpus looks up hits in a vectorised pass and shuffles these alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import U64, Words, signed, slices, text_column
from quillgraph.storage import cut

#: Pseudo-documents of a token: a constant, and the prior's weight on the token's frequency.
PRIOR_EACH = 0.5
PRIOR_CORPUS = 100.0
#: Least z of a token's log-odds that lets it score above the drift.
MIN_Z = 2.0
#: A token's score is its log-odds up to this much, so that no single word outweighs a passage.
MAX_SCORE = 6.0
#: The law of chance is measured on segments of clean text from this score on, and holds for such segments alone.
COUNT_FROM = 3.0
#: One labelled document in so many is kept from training and calibrates the statistics.
HELD_OUT = 4
DRIFT = 0.25
#: A document is toxic where clean text would show so much in at most this many of as many documents.
MAX_EXPECTED = 1e-3
#: Largest lexicon that is sent to every executor; a larger one is joined with all tokens.
BROADCAST_TOKENS = 2_000_000
#: Labels up to this number are sent to every executor for the training join.
BROADCAST_LABELS = 1_000_000


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of each row. Hashes are cut to 44 bits, so that one sort finds them."""
    key = np.unique((words.row.astype(U64) << U64(44)) | (words.hash >> U64(20)))
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1)


def _narrow(col: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in slices(col):
        for at in range(a, b, 1 << 19):
            yield at, min(b, at + (1 << 19))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, (token, documents, toxic documents, clean documents), the latter two of the training documents."""
    for batch in batches:
        col = text_column(batch)
        toxic = batch.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)
        tokens, kinds = [], []
        for a, b in _narrow(col):
            row, token = _distinct(Words(col.slice(a, b - a)))
            tokens.append(token)
            kinds.append(toxic[row + a])
        if tokens:
            token, at = np.unique(np.concatenate(tokens), return_inverse=True)
            kind = np.concatenate(kinds)
            counts = [np.bincount(at, w, len(token)).astype(np.int64) for w in (None, kind == 1, kind == 0)]
            yield pa.RecordBatch.from_arrays([signed(token), *map(pa.array, counts)], ["token", "n", "n_toxic", "n_clean"])


def _with_labels(docs: DataFrame, labels: DataFrame, broadcast_labels: int) -> DataFrame:
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("bigint").alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    known = known.withColumn("toxic", F.when(held, F.col("toxic") + 2).otherwise(F.col("toxic")))  # 2 and 3: clean and toxic, held out
    return docs.join(F.broadcast(known) if labels.count() <= broadcast_labels else known, "doc_id", "left")


def _lookup(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(doc, n_tokens, positions, scores) of documents that hold positive tokens."""
    tokens, scores = shared.value
    sieve = np.zeros(1 << 20, bool)
    sieve[tokens & U64((1 << 20) - 1)] = True
    for batch in batches:
        col, ids = text_column(batch), batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).to_numpy()
        toxic = batch.column("toxic")
        for a, b in slices(col):
            words = Words(col.slice(a, b - a))
            token = words.hash >> U64(20)
            maybe = np.flatnonzero(sieve[token & U64((1 << 20) - 1)])
            if not len(maybe) or not len(tokens):
                continue
            at = np.minimum(np.searchsorted(tokens, token[maybe]), len(tokens) - 1)
            real = tokens[at] == token[maybe]
            hit, at = maybe[real], at[real]
            if len(hit):
                row = words.row[hit]
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                offsets = pa.array(np.append(heads, len(row)).astype(np.int32))
                rows = row[heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows + a]), toxic.take(pa.array(rows + a)), pa.array(words.counts[rows].astype(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(words.position[hit].astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(scores[at]))],
                    ["doc_id", "toxic", "n_tokens", "positions", "scores"],
                )


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_tokens, position, token) of every word; rows are numbered, so that repeated documents stay apart."""
    for batch in batches:
        col, number = text_column(batch), batch.column("row").to_numpy()
        for a, b in slices(col):
            words = Words(col.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[words.row + a]), pa.array(words.counts[words.row].astype(np.int64)), pa.array(words.position.astype(np.int64)), signed(words.hash >> U64(20))],
                ["row", "n_tokens", "position", "token"],
            )


def segments(positions: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a token sequence, in linear time, in order.

    positions are those of the positive tokens, in order, and scores theirs; every other token scores -drift.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, link to the nearest smaller sum before
    total, past = 0.0, 0
    for p, s in zip(positions, scores):
        before = total - drift * (p - past)
        total, past = before + s, p + 1
        start, end, low, high = p, p + 1, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def extreme_value_scale(p_scores: np.ndarray, scores: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum of p * exp(lambda * score) = 1 over clean tokens, those without a score at -drift."""
    rest = 1 - p_scores.sum()
    f = lambda x: float((p_scores * np.exp(x * scores)).sum() + rest * math.exp(-x * drift) - 1)
    if not len(scores):
        return 1.0
    high = 1e-3
    while f(high) <= 0 and high < 64:
        high *= 2
    low = high / 2
    while f(low) > 0 and low > 1e-9:
        low /= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return low


HIT_SCHEMA = "doc_id bigint, toxic bigint, n_tokens bigint, positions array<bigint>, scores array<double>"
FOUND_SCHEMA = "doc_id bigint, toxic bigint, n_tokens bigint, starts array<bigint>, ends array<bigint>, scores array<double>"


def _segmented(batches: Iterator[pa.RecordBatch], drift: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [segments(p, s, drift) for p, s in zip(batch.column("positions").to_pylist(), batch.column("scores").to_pylist())]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        lists = [pa.array([[s[i] for s in own] for own in found], pa.list_(t)) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("n_tokens"), *lists], ["doc_id", "toxic", "n_tokens", "starts", "ends", "scores"])


def _hits(texts: DataFrame, tokens: DataFrame, n: int, broadcast_tokens: int) -> DataFrame:
    """Rows of HIT_SCHEMA; tokens: (token, score), n of them."""
    if n <= broadcast_tokens:
        table = tokens.orderBy("token").toArrow()
        shared = texts.sparkSession.sparkContext.broadcast((table["token"].to_numpy().view(U64), table["score"].to_numpy()))
        return texts.mapInArrow(lambda it: _lookup(it, shared), HIT_SCHEMA)
    rows = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "text").mapInArrow(_all_tokens, "row bigint, n_tokens bigint, position bigint, token bigint").join(tokens, "token")
    listed = each.groupBy("row").agg(F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("position", "score"))).alias("x"))
    named = rows.select("row", "doc_id", "toxic").join(listed, "row")
    return named.select("doc_id", "toxic", "n_tokens", F.col("x.position").alias("positions"), F.col("x.score").alias("scores"))


def expected_together(t: Column, r: Column) -> Column:
    """About exp(-t) * t**(r - 1) / (r! * (r - 1)!), by sums of logarithms: the chance of r segments whose normalised scores add up to t."""
    factorial = F.aggregate(F.sequence(F.lit(1), r), F.lit(0.0), lambda a, x: a + F.log(x))
    return F.exp(-t + (r - 1) * F.log(F.greatest(t, F.lit(1.0))) - 2 * factorial + F.log(r))


def toxic_documents(
    docs: DataFrame, labels: DataFrame, max_expected: float = MAX_EXPECTED, min_z: float = MIN_Z, drift: float = DRIFT, max_score: float = MAX_SCORE,
    count_from: float = COUNT_FROM, broadcast_tokens: int = BROADCAST_TOKENS, broadcast_labels: int = BROADCAST_LABELS,
) -> DataFrame:
    """(doc_id, n_tokens, expected, score, starts, ends, scores) of the documents that hold significant toxic passages.

    starts, ends and scores list the significant segments, by token position; score is their sum. expected is the number of
    documents of this length that clean text would give with the best segment or with all significant segments together, whichever
    is less; at most max_expected. Labels other than 0 and 1 count as none; where labels differ on a document, toxic holds.
    A token scores at most max_score, and segments that score less than count_from are chance: the law is measured from there on.

    Without toxic or without clean labelled documents there is nothing to learn and the result is empty. Null, empty and wordless texts are
    never toxic; very long texts are scanned whole, and the chance grows with their length; rows with a null doc_id are left out; repeated rows are each
    counted and each given. Of equal scores none comes first: all significant segments are listed, by position. Clashing column names do
    not matter: only doc_id and text are read. The lexicon is sent out up to broadcast_tokens and joined beyond, labels up to broadcast_labels.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    known = _with_labels(texts, labels, broadcast_labels)
    counts = cut(known.select("text", "toxic").mapInArrow(_count, "token bigint, n bigint, n_toxic bigint, n_clean bigint").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "n_toxic", "n_clean"))))
    total, toxic, clean, kinds = (float(x or 0) for x in counts.agg(F.sum("n"), F.sum("n_toxic"), F.sum("n_clean"), F.count("*")).first())
    prior = PRIOR_EACH + PRIOR_CORPUS * F.col("n") / max(total, 1)
    weight = PRIOR_EACH * kinds + PRIOR_CORPUS
    t, c = F.col("n_toxic") + prior, F.col("n_clean") + prior
    odds = F.log(t / (toxic + weight - t)) - F.log(c / (clean + weight - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    scored = counts.where(z >= min_z).select("token", F.least(odds, F.lit(max_score)).alias("score"), (c / (clean + weight)).alias("p"))
    tokens = cut((scored if toxic and clean else scored.limit(0)).where(F.col("score") > 0))
    by_score = tokens.groupBy(F.round("score", 2).alias("score")).agg(F.sum("p").alias("p"), F.count("*").alias("n")).toPandas()
    scale = extreme_value_scale(by_score["p"].to_numpy(float), by_score["score"].to_numpy(float), drift)
    found = cut(_hits(known, tokens.select("token", "score"), int(by_score["n"].sum()), broadcast_tokens).mapInArrow(lambda it: _segmented(it, drift), FOUND_SCHEMA))
    # Of clean text, n words show about K * n * exp(-lambda * x) segments of score x or more. K by all held-out clean documents, with half a segment added.
    size = known.where("toxic = 2").select(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    seen = found.where("toxic = 2").select(F.explode("scores").alias("s")).where(F.col("s") >= count_from).agg(F.count("*")).first()[0]
    log_k = math.log((seen + 0.5) / max(size, 1)) + scale * count_from
    chance = lambda s: F.exp(F.lit(log_k) + F.log(F.col("n_tokens").cast("double")) - F.lit(scale) * s)
    # Passages below count_from are what clean text is full of; the law is not measured there, and they prove nothing.
    significant = F.filter(F.arrays_zip("starts", "ends", "scores"), lambda x: (x["scores"] >= count_from) & (chance(x["scores"]) <= 1))
    judged = found.withColumn("__s", significant).where(F.size("__s") > 0)
    # All of them together (Karlin and Altschul), with t the sum of lambda * s - ln(K n).
    score = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x["scores"])
    r = F.size("__s")
    together = expected_together(F.lit(scale) * score - r * (F.lit(log_k) + F.log(F.col("n_tokens").cast("double"))), r)
    best = chance(F.array_max("scores"))
    return (
        judged.withColumns({"expected": F.least(best, together), "score": score})
        .where(F.col("expected") <= max_expected)
        .select("doc_id", "n_tokens", "expected", "score", F.col("__s.starts").alias("starts"), F.col("__s.ends").alias("ends"), F.col("__s.scores").alias("scores"))
    )
