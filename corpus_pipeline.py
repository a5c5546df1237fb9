"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph.llm.decontam import drop_contaminated
from quillgraph.llm.linedup import drop_duplicate_lines
from quillgraph.llm.packing import best_fit_packing
from quillgraph.llm.quality import quality_lines
from quillgraph.llm.simhash import drop_near_duplicates
from quillgraph.session import shipped
from quillgraph.storage import remove, stored

#: SQL can't express edit joins, fingerprints or packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that lose too much text.

    Null, empty and blank texts are rejected, very long ones judged whole. Repeated rows and ties are judged alike. All columns of docs, with nulls in any, come
    back as they were, also such as are named like the operator's statistics; only text and n_chars are renewed. An empty table gives an empty one.
    """
    return quality_lines(docs, stats=False).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which nothing is left.

    Rows with a null doc_id or text and empty texts stay as they are; very long texts lose lines like others. The first occurrence by (doc_id, line) stays, and
    rows repeated with one doc_id are one document. Other columns come back as they were. An empty table gives an empty one.
    """
    return drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group stays, the one with the smallest doc_id.

    Rows with a null doc_id, and null, empty and wordless texts, are in no group and stay; very long texts are read whole. Rows repeated with one doc_id stay or go
    together. All columns come back as they were. An empty table gives an empty one.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows with a null doc_id or text and empty texts stay; very long texts are searched whole; repeated rows go or stay together. All columns come
    back as they were. An empty table of documents gives an empty one; an empty benchmark removes nothing.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become bins of at most 2048 words: (bin, used, doc_ids, starts, lengths).

    Rows with a null doc_id and null, empty and blank texts are in no bin; very long texts are cut into whole bins and a rest. Ties go by doc_id; repeated rows are packed as
    often as they come. Other columns are not read. An empty table gives no bins.
    """
    return best_fit_packing(docs)


STAGES = [
    ("quality rules", shipped(quality_rules)),
    ("line dedup", shipped(line_dedup)),
    ("near dedup", shipped(near_dedup)),
    ("benchmark decontamination", shipped(decontamination)),
    ("best-fit packing", shipped(packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, over documents; a stage's table is deleted when the next one is written, so only the last one's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return result
        docs = stored(result, f"stage{k + 1}")
        if held is not None:
            remove(held)
        held = docs
