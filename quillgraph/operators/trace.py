"""What a retrieval is about to do and has done, for a closer look."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators.retrieve import falling, flows, top_k
from quillgraph.storage import hinted


def _4(c):
    return F.round(c, 4)


def trace_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.select("qid", "name", _4(F.col("resource")).alias("resource"))


def trace_flows(state: DataFrame, edges: DataFrame, questions: DataFrame, entities: DataFrame, decay: float = 0.7, threshold: float = 0.01, k: int = 15) -> DataFrame:
    """(qid, rank, src, relation, dst, forward, sim, contrib): the k edge rows of each question that would carry most in the next step.

    Always gated; no threshold on the sum of a destination.
    """
    q = hinted(questions.select("qid", "embedding").withColumn("q_norm", V.norm("embedding")))
    known = entities.where("description_embedding IS NOT NULL").select(F.col("name").alias("dst"), "description_embedding")
    met = flows(state, edges, threshold).join(known, "dst").join(q, "qid").withColumn("sim", V.cosine("description_embedding", "embedding", None, "q_norm"))
    carried = met.withColumn("contrib", F.col("src_resource") * decay * V.relu(F.col("sim"))).where("contrib > 0")
    order = [falling("contrib"), F.asc("src"), F.asc("dst"), F.asc("forward"), F.asc("relation")]
    return top_k(carried, k, order).select("qid", "rank", "src", "relation", "dst", "forward", _4(F.col("sim")).alias("sim"), _4(F.col("contrib")).alias("contrib"))


def trace_state(state: DataFrame, k: int = 20) -> DataFrame:
    return top_k(state, k, [falling("resource"), F.asc("name")]).select("qid", "rank", "name", _4(F.col("resource")).alias("resource"))


def active_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, updated): entities that a step gave resource."""
    old = before.select("qid", "name", F.col("resource").alias("old"))
    return after.join(old, ["qid", "name"], "left").where("old IS NULL OR resource > old").groupBy("qid").agg(F.count("*").alias("updated"))
