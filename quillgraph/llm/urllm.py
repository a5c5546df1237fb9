"""Operator 9, URL filters by the ratio of two character language models.

One variable-order Markov model of accepted URLs and one of rejected URLs, over bytes with contexts of 0 to ORDER bytes; each context mixes its own
counts with the next shorter context by Witten and Bell's escape weight. A URL's score is the log-likelihood difference per byte.

Labelled examples come with the pages or from seeds: a URL whose host matches SEEDS is a rejected example, every other an accepted one. One site in
HELD_OUT is kept from training, with all its URLs. The threshold is the score that divides the held-out examples of both classes best, so it is set on sites
that the models have never seen, as most sites of a crawl are.

Counts are gathered as (ORDER + 1)-grams per class; both models fall apart by the last context byte and are computed in groups, down to one
log-ratio per gram. That table is looked up in place while small, and joined otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.llm.textkit import U64, raw, slices, text_column
from quillgraph.storage import cut

#: Longest context, in bytes; at most 6.
ORDER = 4
#: One site in so many calibrates the threshold and is in neither model.
HELD_OUT = 4
#: What the loss of an accepted URL costs, against a rejected one that passes; both as shares of their held-out examples.
ACCEPTED_COST = 10.0
#: Scores are compared in steps of this much when the threshold is looked for.
SCORE_STEP = 0.005
SEEDS = r"(?i)^[a-z]+://[^/]*(spam|pills|casino|free-bets|adult|porn|viagra|ads-track)"
#: A site: the host without port, user and the usual first labels.
SITE = r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:(?:www[0-9]*|m|mobile|blog)\.)?([^/?#:]*)"
BROADCAST_GRAMS = 4_000_000


def codes(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For every byte, itself and its order predecessors in one number; zeros before a row's start."""
    code = data.astype(U64)
    firsts = off[:-1]
    for s in range(1, order + 1):
        before = np.zeros(len(data), U64)
        before[s:] = data[:-s]
        for j in range(s):
            before[(firsts + j)[firsts + j < len(data)]] = 0
        code |= before << U64(8 * s)
    return code


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(gram, accepted, rejected) per batch; grams of URLs that don't train have zeros, so that their ratios are computed too."""
    for batch in batches:
        col, kind = text_column(batch, "url"), batch.column("kind").to_numpy(zero_copy_only=False)
        for a, b in slices(col):
            data, off = raw(col.slice(a, b - a))
            gram, at = np.unique(codes(data, off, order), return_inverse=True)
            own = kind[a + np.repeat(np.arange(len(off) - 1), np.diff(off))]
            n = [pa.array(np.bincount(at, own == k, len(gram)).astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), *n], ["gram", "accepted", "rejected"])


def log_probability(gram: np.ndarray, n: np.ndarray, order: int, short: np.ndarray) -> np.ndarray:
    """log P of each gram's byte in its context, from counts n of the grams of one last context byte; short: probabilities without context."""
    byte, context = (gram & U64(255)).astype(np.int64), gram >> U64(8)
    p = short[byte]
    for length in range(1, order + 1):
        own = context & U64((1 << (8 * length)) - 1)
        _, c = np.unique(own, return_inverse=True)
        _, first, g = np.unique((own << U64(8)) | byte.astype(U64), return_index=True, return_inverse=True)
        seen = np.bincount(g, n)
        total = np.bincount(c, n)[c]
        kinds = np.bincount(c[first], seen > 0, c.max() + 1)[c]  # different bytes that follow the context
        p = np.where(total > 0, (seen[g] + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p)


def _ratios(table: pa.Table, order: int, good: np.ndarray, bad: np.ndarray) -> pa.Table:
    gram = table.column("gram").to_numpy().view(U64)
    parts = [log_probability(gram, table.column(c).to_numpy().astype(float), order, short) for c, short in (("accepted", good), ("rejected", bad))]
    return pa.table({"gram": table.column("gram"), "ratio": parts[0] - parts[1]})


def gram_ratios(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) of all grams of rows (url, kind); kind is 0 where the URL trains the accepted model, 1 the rejected one, else neither."""
    counted = urls.select("url", "kind").mapInArrow(lambda it: _count(it, order), "gram bigint, accepted bigint, rejected bigint")
    counts = cut(counted.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    bytes_ = counts.groupBy(F.col("gram").bitwiseAND(F.lit(255)).alias("b")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).toPandas()  # 256 rows at most
    short = np.ones((2, 256))
    short[0, bytes_["b"]] += bytes_["a"]
    short[1, bytes_["b"]] += bytes_["r"]
    good, bad = short / short.sum(axis=1, keepdims=True)
    last = F.shiftright("gram", 8).bitwiseAND(F.lit(255)).cast("int")
    return counts.withColumn("last", last).groupBy("last").applyInArrow(lambda t: _ratios(t, order, good, bad), "gram bigint, ratio double")


def _score(batches: Iterator[pa.RecordBatch], shared, order: int) -> Iterator[pa.RecordBatch]:
    grams, ratios = shared.value
    for batch in batches:
        col = text_column(batch, "url")
        for a, b in slices(col):
            data, off = raw(col.slice(a, b - a))
            own = ratios[np.searchsorted(grams, codes(data, off, order))]
            sums = np.concatenate([[0.0], np.cumsum(own)])
            score = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(score)], [*batch.schema.names, "score"])


def _grams_of(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col, row = text_column(batch, "url"), batch.column("row").to_numpy()
        for a, b in slices(col):
            data, off = raw(col.slice(a, b - a))
            at = np.repeat(np.arange(len(off) - 1), np.diff(off))
            yield pa.RecordBatch.from_arrays([pa.array(row[a + at]), pa.array(codes(data, off, order).astype(np.int64))], ["row", "gram"])


def url_scores(pages: DataFrame, order: int = ORDER, bad: Column | None = None, held_out: int = HELD_OUT, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(page_id, url, bad, held, score) of rows with a URL. bad marks examples: true rejected, false accepted, null neither; by SEEDS if not given.

    held tells that the URL's site is kept from training; with held_out 0 none is. An empty URL scores 0. score is positive for URLs
    more like accepted ones.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    mark = F.col("url").rlike(SEEDS) if bad is None else bad
    held = F.pmod(F.xxhash64(F.lower(F.regexp_extract("url", SITE, 1))), F.lit(held_out)) == 0 if held_out else F.lit(False)
    urls = pages.where("url IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), "url", mark.alias("bad"), held.alias("held"))
    urls = urls.withColumn("kind", F.when(F.col("held") | F.col("bad").isNull(), 2).otherwise(F.col("bad").cast("int")))
    ratios = cut(gram_ratios(urls, order))
    if ratios.count() <= broadcast_grams:
        table = ratios.orderBy("gram").toArrow()
        shared = pages.sparkSession.sparkContext.broadcast((table["gram"].to_numpy().astype(U64), table["ratio"].to_numpy()))
        scored = urls.mapInArrow(lambda it: _score(it, shared, order), "page_id bigint, url string, bad boolean, held boolean, kind int, score double")
        return scored.drop("kind")
    rows = cut(urls.withColumn("row", F.monotonically_increasing_id()))
    sums = rows.select("url", "row").mapInArrow(lambda it: _grams_of(it, order), "row bigint, gram bigint").join(ratios, "gram").groupBy("row").agg(F.avg("ratio").alias("score"))
    return rows.join(sums, "row", "left").select("page_id", "url", "bad", "held", F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold(steps: np.ndarray, accepted: np.ndarray, rejected: np.ndarray, accepted_cost: float = ACCEPTED_COST) -> float:
    """The score from which URLs pass, from held-out examples counted by falling or rising step of score.

    It minimises the share of rejected examples that pass plus accepted_cost times the share of accepted ones that don't, and lies in the
    middle of the steps that do equally well. Where no rejected example was held out it is 0, where both models say the same, or lower,
    so that no held-out accepted one is lost; without accepted ones it is 0.
    """
    order = np.argsort(steps)
    steps, accepted, rejected = steps[order].astype(float), accepted[order], rejected[order]
    if not rejected.sum() or not accepted.sum():
        return min(0.0, float(steps[accepted > 0].min(initial=0.0)))
    # With the threshold under step i, steps before i fail and the others pass; last, all fail.
    lost = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    cost = passed + accepted_cost * lost
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    first = int(best[0])
    low = steps[first - 1] if first else steps[0] - 1.0
    high = steps[first] if first < len(steps) else steps[-1] + 1.0
    return float((low + high) / 2)


def accepted_urls(pages: DataFrame, order: int = ORDER, accepted_cost: float = ACCEPTED_COST, bad: Column | None = None, held_out: int = HELD_OUT) -> DataFrame:
    """(page_id, url, score) of the URLs whose score is at least the threshold; every URL is scored, examples too, and only the score decides.

    A null URL never passes; a null page_id is kept. Repeated rows count and are given as often as they come; equal scores pass or fail together. Long URLs
    are read whole, and their score is a mean like any other. Where all URLs are rejected examples none passes but the empty one, which scores 0; without
    rejected examples the rejected model is uniform. An empty table gives an empty result; other columns are not read.
    """
    scored = cut(url_scores(pages, order, bad, held_out))
    step = F.round(F.col("score") / SCORE_STEP).cast("bigint").alias("step")
    # As many rows as there are steps between the lowest and the highest score, whatever the number of URLs.
    found = scored.where("held AND bad IS NOT NULL").groupBy(step).agg(F.count_if(~F.col("bad")).alias("accepted"), F.count_if("bad").alias("rejected")).toPandas()
    least = threshold(found["step"].to_numpy() * SCORE_STEP, found["accepted"].to_numpy(), found["rejected"].to_numpy(), accepted_cost)
    return scored.where(F.col("score") >= F.lit(least)).select("page_id", "url", "score")
