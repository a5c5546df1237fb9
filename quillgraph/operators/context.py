"""Retrieved paths and entities as the text that an answering model reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillgraph.functions import text as T


def context_text(questions: DataFrame, paths: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, paths_text, descriptions_text) of every question, lines in the order of rank.

    A question without paths and entities says so in both; otherwise a missing part has its own sentence.
    """
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("t")))), lambda x: x["t"]), "\n")
    p = paths.groupBy("qid").agg(lines(T.path_text("names", "edges")).alias("p"))
    bullet = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.col("description")))
    # collect_list keeps structs whose text is null; array_join leaves nulls out.
    e = entities.groupBy("qid").agg(lines(bullet).alias("d"), F.count("*").alias("n"))
    joined = questions.select("qid").distinct().join(p, "qid", "left").join(e, "qid", "left")
    nothing = F.col("p").isNull() & F.col("n").isNull()
    text = F.when(F.coalesce("d", F.lit("")) == "", T.NO_DESCRIPTIONS).otherwise(F.col("d"))
    return joined.select("qid", F.coalesce("p", F.lit(T.NO_PATHS)).alias("paths_text"), F.when(nothing, T.NO_ENTITIES).otherwise(text).alias("descriptions_text"))
