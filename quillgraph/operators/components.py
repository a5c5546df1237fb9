"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.storage import BROADCAST_BYTES, cut, hinted


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(rows: DataFrame, broadcast_bytes: int) -> DataFrame:
    """rows (u, v) with m, the least v of each u.

    The minima are a partial aggregate, so no task meets all rows of a hub. They are stored before they are joined back: while small they
    are sent out and the rows stay where they are; beyond, both sides of the join are shuffles of their own, which adaptive execution can split where a hub is large.
    """
    return rows.join(hinted(cut(rows.groupBy("u").agg(F.min("v").alias("m"))), broadcast_bytes), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reached.

    Edges are undirected. Self-loops give a component of their own; edges with a null end are ignored;
    repeated edges change nothing; an empty table gives an empty result. The number of rounds grows
    with the logarithm of the component size. Of either star, the minima are sent out up to broadcast_bytes and joined beyond.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    ends = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())  # edges are computed once
    e = ends.where("u <> v")
    loops = ends.where("u = v").select(F.col("u").alias("node"))
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = _with_least(both, broadcast_bytes).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = _with_least(cut(large), broadcast_bytes)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).where("u <> v").distinct()
        e = cut(small)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")))
    return found.union(loops.select("node", F.col("node"))).groupBy("node").agg(F.min("component").alias("component"))
