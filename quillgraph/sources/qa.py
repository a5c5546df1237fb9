"""Question-answering datasets as examples, CSV-free: nested projections over what the files hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillgraph.functions.text import strip

EXAMPLE_SCHEMA = "seq bigint, question string, answer string, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>"


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A dataset split kept as Parquet or JSON lines, by the path's ending."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def answerable(raw: DataFrame) -> DataFrame:
    """Rows marked answerable; all rows where there is no such mark."""
    return raw.where("answerable") if "answerable" in raw.columns else raw


def multi_paragraph_examples(raw: DataFrame) -> DataFrame:
    """Examples from rows (seq, question, answer, paragraphs array<struct<title,paragraph_text,is_supporting>>)."""
    paragraphs = F.transform("paragraphs", lambda p: F.struct(p["title"].alias("title"), p["paragraph_text"].alias("text"), p["is_supporting"].alias("is_supporting")))
    return answerable(raw).select("seq", "question", "answer", paragraphs.alias("paragraphs"))


def context_pairs(context: Column, kind: T.DataType) -> Column:
    """array<struct<title,sentences>> from a struct of parallel lists (cut to the shorter), a list of structs, or a list of [title, sentences] structs.

    Blank titles are dropped in the two list forms only.
    """
    if isinstance(kind, T.StructType):
        n = F.least(F.size(context["title"]), F.size(context["sentences"]))
        zipped = F.arrays_zip(F.slice(context["title"], F.lit(1), F.greatest(n, F.lit(0))).alias("title"), F.slice(context["sentences"], F.lit(1), F.greatest(n, F.lit(0))).alias("sentences"))
        return F.when((F.size(context["title"]) > 0) & (F.size(context["sentences"]) > 0), zipped).otherwise(F.slice(zipped, 1, 0))
    title, sentences = kind.elementType.names[:2]
    pairs = F.transform(context, lambda p: F.struct(p[title].alias("title"), p[sentences].alias("sentences")))
    return F.filter(pairs, lambda p: F.coalesce(strip(p["title"]), F.lit("")) != "")


def supporting_titles(facts: Column, kind: T.DataType) -> Column:
    """The distinct titles of supporting facts, given as a struct of lists or a list of structs."""
    if isinstance(kind, T.StructType):
        return F.array_distinct(facts["title"])
    return F.array_distinct(F.transform(facts, lambda f: f[kind.elementType.names[0]]))


def context_examples(raw: DataFrame) -> DataFrame:
    """Examples from rows (seq, question, answer, context, supporting_facts).

    Sentences are stripped, blank ones dropped and the rest joined by spaces; paragraphs without text go. Of a list of answers the first
    counts. Examples with a blank question or answer, or without paragraphs, are dropped.
    """
    raw = answerable(raw)
    pairs = context_pairs(F.col("context"), raw.schema["context"].dataType)
    supporting = supporting_titles(F.col("supporting_facts"), raw.schema["supporting_facts"].dataType)
    text = lambda p: F.array_join(F.filter(F.transform(p["sentences"], strip), lambda s: s != ""), " ")
    paragraphs = F.transform(pairs, lambda p: F.struct(p["title"].alias("title"), text(p).alias("text"), F.coalesce(F.array_contains(supporting, p["title"]), F.lit(False)).alias("is_supporting")))
    listed = isinstance(raw.schema["answer"].dataType, T.ArrayType)
    answer = F.coalesce(F.try_element_at("answer", F.lit(1)) if listed else F.col("answer"), F.lit("")).cast("string")
    out = raw.select("seq", F.coalesce(F.col("question").cast("string"), F.lit("")).alias("question"), answer.alias("answer"), F.filter(paragraphs, lambda p: p["text"] != "").alias("paragraphs"))
    return out.where((strip("question") != "") & (strip("answer") != "") & (F.size("paragraphs") > 0))


def run_query(spark: SparkSession, text: str, **values) -> DataFrame:
    """SQL over registered views with named parameters."""
    return spark.sql(text, args=values)
