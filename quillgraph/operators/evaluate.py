"""Scores of answers, summaries over configurations, latencies and fingerprints."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.operators.retrieve import Retrieval, Settings, retrieve
from quillgraph.storage import cut

ROW_SCHEMA = (
    "question_id string, question string, ground_truth string, prediction string, em double, f1 double, llm_accuracy double, prompt_tokens bigint, "
    "completion_tokens bigint, total_tokens bigint, retrieval_s double, generation_s double, num_paths bigint, num_entities bigint, num_seeds bigint, "
    "steps_taken bigint, seed_entities string, extracted_entities string"
)
#: The published sweep: a baseline without a graph, one without the gate, and steps and decay varied.
ABLATION = [
    Settings("naive-vector", naive_vector=True),
    Settings("no-query-aware", query_aware=False),
    *(Settings(f"steps-{n}", max_steps=n) for n in (1, 2, 3, 4)),
    *(Settings(f"decay-{d}", decay=d) for d in (0.3, 0.5, 0.7, 0.9, 1.0)),
]


def score(answers: DataFrame) -> DataFrame:
    """answers (…, prediction, ground_truth) with em and f1."""
    return answers.withColumns({"em": T.exact_match("prediction", "ground_truth"), "f1": T.token_f1("prediction", "ground_truth")})


def evaluation_rows(answers: DataFrame, result: Retrieval | None = None, query_entities: DataFrame | None = None) -> DataFrame:
    """The 18 columns of ROW_SCHEMA from scored answers with question_id, missing ones by default values; counts and lists from result by qid."""
    out = answers
    if result is not None:
        names = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "name"))), lambda x: x["name"]), ", ")
        counts = [
            result.paths.groupBy("qid").agg(F.count("*").alias("num_paths")),
            result.entities.groupBy("qid").agg(F.count("*").alias("num_entities")),
            result.seeds.groupBy("qid").agg(F.count("*").alias("num_seeds"), names((-F.col("resource")).alias("o")).alias("seed_entities")),
            result.steps_taken.select("qid", "steps_taken"),
        ]
        if query_entities is not None:
            counts.append(query_entities.groupBy("qid").agg(names(F.col("pos")).alias("extracted_entities")))
        for c in counts:
            out = out.drop(*(x for x in c.columns if x != "qid")).join(c.withColumnRenamed("qid", "question_id"), "question_id", "left")
    schema = [f.strip().split() for f in ROW_SCHEMA.split(",")]
    empty = {"string": F.lit(""), "double": F.lit(0.0), "bigint": F.lit(0)}
    value = lambda c, t: F.col(c) if c == "llm_accuracy" and c in out.columns else F.coalesce(F.col(c), empty[t]) if c in out.columns else F.lit(None) if c == "llm_accuracy" else empty[t]
    return out.select(*(value(c, t).cast(t).alias(c) for c, t in schema))


def summary(rows: DataFrame, by: str = "config") -> DataFrame:
    """Means by configuration, the best f1 first. Nulls and NaN are skipped; llm_acc is null where no row was judged."""
    mean = lambda c: F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    names = {"em": "em", "f1": "f1", "avg_prompt_tok": "prompt_tokens", "avg_total_tok": "total_tokens", "avg_paths": "num_paths", "avg_entities": "num_entities", "llm_acc": "llm_accuracy", "avg_retrieval_s": "retrieval_s", "avg_generation_s": "generation_s"}
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *(mean(c).alias(a) for a, c in names.items() if c in rows.columns))
    return out.orderBy(F.desc("f1"), F.asc(by))


def latency(rows: DataFrame, by: str = "config", value: str = "retrieval_s") -> DataFrame:
    """Mean, median, 95th percentile (linear between ranks) and maximum, the lowest mean first."""
    v = F.col(value)
    return rows.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean_s"), F.percentile(v, F.lit(0.5)).alias("p50_s"), F.percentile(v, F.lit(0.95)).alias("p95_s"), F.max(v).alias("max_s")).orderBy("mean_s", by)


def patch_latency(rows: DataFrame, timings: DataFrame) -> DataFrame:
    """rows with retrieval_s from timings (question_id, retrieval_s) where it has one. Of several timings of a question the smallest counts."""
    new = timings.groupBy("question_id").agg(F.min("retrieval_s").alias("__new"))
    return rows.join(new, "question_id", "left").withColumn("retrieval_s", F.coalesce("__new", "retrieval_s")).select(rows.columns)


def trailing(rows: DataFrame, n: int = 100, by: str | None = None) -> DataFrame:
    """rows (seq, em, f1) with the means over the last n rows up to each, in the order of completion."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("seq").rowsBetween(-(n - 1), 0)
    return rows.withColumns({"em_trailing": F.avg("em").over(w), "f1_trailing": F.avg("f1").over(w)})


def running(rows: DataFrame, every: int = 25, by: str | None = None) -> DataFrame:
    """The means so far, at every n-th row; columns done, em_running and f1_running."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"done": F.row_number().over(w), "em_running": F.avg("em").over(upto), "f1_running": F.avg("f1").over(upto)})
    return out.where(F.col("done") % every == 0)


def fingerprints(result: Retrieval, questions: DataFrame) -> DataFrame:
    """(qid, seeds, entities, paths): each sorted, so that ties in order don't show."""
    sets = [(result.seeds, "seeds", F.col("name")), (result.entities, "entities", F.col("name")), (result.paths, "paths", F.array_join("names", "\x1f"))]
    out = questions.select("qid")
    for df, alias, value in sets:
        out = out.join(df.groupBy("qid").agg(F.sort_array(F.collect_list(value)).alias(alias)), "qid", "left")
    return out.select("qid", *(F.coalesce(a, F.array().cast("array<string>")).alias(a) for _, a, _ in sets))


def same_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, matches, all_match) over the questions of a."""
    other = b.select("qid", F.struct("seeds", "entities", "paths").alias("o"))
    each = a.join(other, "qid", "left").select(F.coalesce(F.struct("seeds", "entities", "paths") == F.col("o"), F.lit(False)).alias("hit"))
    return each.agg(F.count("*").alias("n"), F.count_if("hit").alias("matches"), F.coalesce(F.bool_and("hit"), F.lit(True)).alias("all_match"))


#: Answers may hold quotes, line breaks and white space at their ends; all of it comes back.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str, config: str) -> None:
    """One configuration's rows as CSV with a header, in a folder of its own under path."""
    rows.write.mode("overwrite").options(**_CSV).csv(f"{path.rstrip('/')}/config={config}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All configurations under path, with their names in config."""
    return spark.read.schema(ROW_SCHEMA + ", config string").options(**_CSV, multiLine=True).csv(path)


def patch_csv(path: str, config: str, timings: DataFrame) -> bool:
    """Replaces retrieval_s of the questions in timings in the CSV of a configuration; False where it has none."""
    rows = cut(read_csv(timings.sparkSession, path).where(F.col("config") == config).drop("config"))  # the files are read before they are written over
    if rows.isEmpty():
        return False
    write_csv(patch_latency(rows, timings), path, config)
    return True


def question_number(qid: str) -> Column:
    """The number at the end of an id such as q_12; null where there is none."""
    return F.regexp_extract(qid, r"([0-9]{1,18})$", 1).try_cast("bigint")


def first_questions(questions: DataFrame, n: int | None) -> DataFrame:
    """The first n questions in source order: by seq where there is such a column, else by the number in qid. All where n is 0 or None."""
    order = ["seq"] if "seq" in questions.columns else [F.asc_nulls_last(question_number("qid")), F.asc("qid")]
    return questions.orderBy(*order).limit(n) if n else questions


def sweep(questions: DataFrame, query_entities: DataFrame, entities: DataFrame, relations: DataFrame, configs: list[Settings] | None = None) -> dict[str, Retrieval]:
    """All questions under every configuration."""
    return {c.name: retrieve(questions, query_entities, entities, relations, c) for c in configs or ABLATION}


def in_groups(questions: DataFrame, query_entities: DataFrame, entities: DataFrame, relations: DataFrame, settings: Settings, workers: int) -> Retrieval:
    """The retrieval with questions in so many groups, whose jobs run at once. No state is shared between groups."""

    def one(g: int) -> Retrieval:
        own = lambda df: df if workers == 1 else df.where(F.pmod(F.xxhash64("qid"), F.lit(workers)) == g)
        r = retrieve(own(questions), own(query_entities), entities, relations, settings)
        return Retrieval(**{f.name: cut(getattr(r, f.name)) for f in fields(Retrieval)})

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(one, range(workers)))
    return Retrieval(**{f.name: reduce(DataFrame.unionByName, [getattr(p, f.name) for p in parts]) for f in fields(Retrieval)})


def benchmark(questions: DataFrame, query_entities: DataFrame, entities: DataFrame, relations: DataFrame, configs: list[Settings], workers: int = 1) -> list[dict]:
    """Seconds of each configuration for all questions, down to stored paths and entities; also per question."""
    n, out = questions.count(), []
    for c in configs:
        began = time.perf_counter()
        in_groups(questions, query_entities, entities, relations, c, workers)
        seconds = time.perf_counter() - began
        out.append({"config": c.name, "seconds": seconds, "questions": n, "seconds_per_question": seconds / max(n, 1)})
    return out


def speedups(questions: DataFrame, query_entities: DataFrame, entities: DataFrame, relations: DataFrame, settings: Settings = Settings(), workers: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(mode, workers, elapsed_s, speedup_vs_serial, matches_serial, questions), one row for each number of groups, against all questions in one group."""

    def run(n: int) -> tuple[float, DataFrame]:
        began = time.perf_counter()
        result = in_groups(questions, query_entities, entities, relations, settings, n)
        return time.perf_counter() - began, cut(fingerprints(result, questions))

    serial, reference = run(1)
    rows = []
    for n in workers:
        seconds, other = (serial, reference) if n == 1 else run(n)
        same = same_fingerprints(reference, other).first()
        rows.append(("serial" if n == 1 else f"parallel x{n}", n, round(seconds, 2), round(serial / seconds, 2), same["matches"], same["n"]))
    return questions.sparkSession.createDataFrame(rows, "mode string, workers int, elapsed_s double, speedup_vs_serial double, matches_serial bigint, questions bigint")


def parallel_guard(workers: int, mode: str) -> None:
    """Several workers on a stateful retriever are refused, as its state would be shared. Here state is never shared; the check keeps the interface."""
    if workers > 1 and mode == "stateful":
        raise ValueError("parallel evaluation needs mode='stateless'")
