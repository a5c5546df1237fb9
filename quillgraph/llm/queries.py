"""The queries opN_* over the synthetic tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.cdx import CDX_SQL, capture_index
from quillgraph.llm.ctw import code_lengths
from quillgraph.llm.decontam import contaminated
from quillgraph.llm.licenses import license_spans
from quillgraph.llm.linedup import duplicate_lines
from quillgraph.llm.packing import best_fit_packing
from quillgraph.llm.quality import QUALITY_SQL, quality_lines
from quillgraph.llm.simhash import near_duplicates
from quillgraph.llm.toxicity import toxic_documents
from quillgraph.llm.urllm import accepted_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines(_table(spark, sf_dir, "documents"))


def op2_license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_table(spark, sf_dir, "documents"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lengths(_table(spark, sf_dir, "documents"))


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index(_table(spark, sf_dir, "pages"))


def op8_simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_urls(_table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_lines": op1_quality_lines,
    "op2_license_spans": op2_license_spans,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_decontaminate": op5_decontaminate,
    "op6_code_lengths": op6_code_lengths,
    "op7_capture_index": op7_capture_index,
    "op8_simhash_pairs": op8_simhash_pairs,
    "op9_url_filter": op9_url_filter,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_lines": QUALITY_SQL, "op7_capture_index": CDX_SQL}
