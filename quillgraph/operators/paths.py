"""Simple paths between active entities, from the seeds outward, and the removal of redundant ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.operators.retrieve import falling, top_k
from quillgraph.storage import cut

#: Longest path, whatever the number of propagation steps.
MAX_HOPS = 4


def _order() -> list:
    return [falling("path_weight"), F.asc(F.size("names")), F.asc("names"), F.asc(F.transform("edges", lambda e: e["forward"].cast("int"))), F.asc(F.transform("edges", lambda e: e["relation"]))]


def all_paths(state: DataFrame, seeds: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(qid, names, edges, path_weight) of all paths of 1 to max_hops edges from a seed over active entities, none twice in a path.

    The active part of the graph is joined once for each question and then walked hop by hop; inactive entities and
    repeated names end a walk where they are met.
    """
    here = state.select("qid", F.col("name").alias("src"))
    there = state.select("qid", F.col("name").alias("dst"), F.col("resource").alias("dst_resource"))
    active = cut(here.join(edges, "src").join(there, ["qid", "dst"]).select("qid", "src", "dst", F.struct("relation", "forward").alias("edge"), "dst_resource"))
    at = seeds.select("qid", "name").distinct().join(state, ["qid", "name"]).select("qid", F.array("name").alias("names"), F.col("resource").alias("total"), F.col("name").alias("src"))
    at = at.withColumn("edges", F.array().cast("array<struct<relation:string,forward:boolean>>"))
    out = None
    for _ in range(max_hops):
        onward = at.join(active, ["qid", "src"]).where(~F.array_contains("names", F.col("dst")))
        at = cut(onward.select("qid", F.array_append("names", F.col("dst")).alias("names"), (F.col("total") + F.col("dst_resource")).alias("total"), F.col("dst").alias("src"), F.array_append("edges", F.col("edge")).alias("edges")))
        out = at if out is None else out.unionByName(at)
    return out.select("qid", "names", "edges", (F.col("total") / F.size("names")).alias("path_weight"))


def collect_paths(state: DataFrame, seeds: DataFrame, edges: DataFrame, k: int = 30, max_hops: int = MAX_HOPS) -> DataFrame:
    """The k heaviest paths of each question with their rank, before any is removed; ties by length, names, directions and relations."""
    return top_k(all_paths(state, seeds, edges, max_hops), k, _order()).select("qid", "rank", "names", "edges", "path_weight")


def deduplicate_paths(paths: DataFrame) -> DataFrame:
    """paths without those whose names, forward or backward, came at a better rank, and without strict prefixes of
    another path's names or of another path's reversed names. Ranks stay as they were.
    """
    back = F.reverse("names")
    key = F.when(F.col("names") <= back, F.col("names")).otherwise(back)
    first = F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))
    kept = cut(paths.withColumn("__first", first).where("__first = 1").drop("__first"))
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda n: F.slice(c, 1, n))
    shorter = kept.select("qid", F.explode(F.concat(prefixes(F.col("names")), prefixes(back))).alias("names")).distinct()
    return kept.join(shorter, ["qid", "names"], "left_anti").select(paths.columns)
