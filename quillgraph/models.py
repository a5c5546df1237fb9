"""Model calls behind small interfaces, with deterministic local stand-ins.

A model is any object with the method below; it is pickled to the executors and called once per row of a partition. Where the calls at once
are bounded, the driver gives out permits, so that the bound is on calls and not on the number of partitions. Calls are retried
where the model says that it was throttled. Results are meant to be cached as tables by content hash, so that only misses are asked.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import nullcontext
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillgraph.permits import permits

R = TypeVar("R")


class Throttled(Exception):
    """Raised by a model that wants the call repeated later."""


class Extractor(Protocol):
    def extract(self, text: str) -> dict | None: ...


class Embedder(Protocol):
    def embed(self, text: str) -> Sequence[float]: ...


class QuestionEntities(Protocol):
    def entities(self, question: str) -> list[dict]: ...


class Generator(Protocol):
    def generate(self, question: str, paths: str, descriptions: str) -> dict: ...


class Judge(Protocol):
    def judge(self, question: str, expected: str, predicted: str) -> str: ...


class GroupResolver(Protocol):
    def resolve(self, cluster: list[str]) -> list[dict]: ...


def retried(call: Callable[[], R], tries: int = 5, base: float = 2.0, on: tuple[type[Exception], ...] = (Throttled,), sleep: Callable[[float], None] = time.sleep) -> R:
    """call's result, repeated after base, 2 * base, 4 * base, ... seconds while it raises one of on; the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except on:
            if n == tries - 1:
                raise
            sleep(base * 2**n)
    raise ValueError("tries must be positive")


class StubExtractor:
    """Capitalised words of four letters or more as entities, neighbours as triples."""

    TYPES = ("PERSON", "PLACE", "WORK", "EVENT", "THING")

    def extract(self, text: str) -> dict | None:
        names = [m.group(0) for m in re.finditer(r"[A-Z][a-z]{3,}( [a-z]+)?", text[:200])]
        return {
            "entities": [{"name": n, "type": self.TYPES[len(n) % 5], "description": f"{n} in text"} for n in names],
            "triples": [{"subject": a, "relation": "near", "object": b} for a, b in zip(names, names[1:])],
        }


class StubEmbedder:
    """A unit vector from the hashes of a text's words: texts that share words are near."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: str) -> Sequence[float]:
        out = [0.0] * self.size
        for word in re.findall(r"\w+", text.lower()):
            h = hashlib.sha256(word.encode()).digest()
            out[h[0] % self.size] += 1.0 if h[1] & 1 else -1.0
            out[h[2] % self.size] += 0.5 if h[3] & 1 else -0.5
        size = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / size for x in out]


class StubQuestionEntities:
    def entities(self, question: str) -> list[dict]:
        return [{"name": m.group(0).lower(), "search_hint": f"{m.group(0)} in {question}"} for m in re.finditer(r"[A-Z][a-z]{3,}", question)]


class StubGenerator:
    """Answers with the last name of the first path."""

    def generate(self, question: str, paths: str, descriptions: str) -> dict:
        quoted = re.findall(r"'([^']*)'", paths.split("\n")[0])
        return {"prediction": quoted[-1] if quoted else "", "prompt_tokens": len(f"{question} {paths} {descriptions}".split()), "completion_tokens": 1}


class StubJudge:
    def judge(self, question: str, expected: str, predicted: str) -> str:
        return "YES" if expected.strip().lower() == predicted.strip().lower() else "NO"


class StubResolver:
    """One group per cluster, under its longest name."""

    def resolve(self, cluster: list[str]) -> list[dict]:
        return [{"canonical_name": max(cluster, key=lambda n: (len(n), n)), "members": list(cluster), "description": "one entity"}]


def _mapped(df: DataFrame, schema: str, columns: dict[str, Callable[[dict], object]], workers: int | None) -> DataFrame:
    """df's rows with further columns, computed row by row in batches; workers bounds the calls that run at once.

    Where it does, the rows are spread evenly over as many partitions as shuffles have (workers at least), and a batch waits for one of workers permits.
    """
    source, free = df, None
    if workers:
        spark = df.sparkSession
        source, free = df.repartition(max(workers, int(spark.conf.get("spark.sql.shuffle.partitions")))), permits(spark, workers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with free.asked() if free else nullcontext(nullcontext) as held:
            for batch in batches:
                rows = batch.to_dict("records")
                with held():
                    found = {name: [f(r) for r in rows] for name, f in columns.items()}
                yield batch.assign(**{name: pd.Series(values, index=batch.index, dtype=object) for name, values in found.items()})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return source.mapInPandas(run, f"{fields}, {schema}")


EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, triples array<struct<subject:string,relation:string,object:string>>"


def extract(documents: DataFrame, model: Extractor, workers: int | None = 3) -> DataFrame:
    """documents (…, doc_text) with entities and triples: null where the model gives nothing, empty where it fails."""

    def call(row: dict) -> dict | None:
        if "__x" not in row:
            try:
                row["__x"] = retried(lambda: model.extract(row["doc_text"]))
            except Exception:  # a failed document is kept as one without entities, as a cached empty result
                row["__x"] = {"entities": [], "triples": []}
        return row["__x"]

    return _mapped(documents, EXTRACTION, {k: (lambda r, k=k: (call(r) or {}).get(k)) for k in ("entities", "triples")}, workers)


def embed(texts: DataFrame, model: Embedder, workers: int | None = 5, text: str = "text") -> DataFrame:
    """(text, embedding) of the distinct texts."""
    return _mapped(texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct(), "embedding array<double>", {"embedding": lambda r: retried(lambda: model.embed(r["text"]))}, workers)


def embed_cached(texts: DataFrame, cache: DataFrame, model: Embedder, name: str, workers: int | None = 5) -> tuple[DataFrame, DataFrame]:
    """Embeddings (text, embedding) of the distinct texts, and the new rows (key, embedding) for the cache, which is asked first."""
    from quillgraph.functions import text as T
    from quillgraph.storage import cut

    keyed = texts.select("text").where("text IS NOT NULL").distinct().withColumn("key", T.sha256(T.joined(F.lit(name), "text")))
    fresh = cut(embed(keyed.join(cache.select("key"), "key", "left_anti"), model, workers).join(keyed, "text").select("key", "embedding"))
    return keyed.join(cache.select("key", "embedding").unionByName(fresh), "key").select("text", "embedding"), fresh


FOUND = "found array<struct<name:string,search_hint:string>>"


def found_entities(questions: DataFrame, model: QuestionEntities) -> DataFrame:
    """(question, found) of rows (question)."""
    return _mapped(questions.select("question"), FOUND, {"found": lambda r: retried(lambda: model.entities(r["question"]))}, None)


def listed_entities(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, pos, name, hint): the query entities of questions (qid, question), in the model's order."""
    return questions.select("qid", "question").join(found, "question").select("qid", F.posexplode("found").alias("pos", "e")).select("qid", "pos", "e.name", F.col("e.search_hint").alias("hint"))


def answer(contexts: DataFrame, model: Generator) -> DataFrame:
    """contexts (question, paths_text, descriptions_text, …) with prediction, token counts and error; a failed question has its error and nothing else."""

    def call(row: dict) -> dict:
        if "__x" not in row:
            try:
                row["__x"] = model.generate(row["question"], row["paths_text"], row["descriptions_text"]) | {"error": None}
            except Exception as e:  # row-level isolation: the question is reported, the others go on
                row["__x"] = {"error": str(e) or type(e).__name__}
        return row["__x"]

    keys = {"prediction": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "error": "string"}
    out = _mapped(contexts, ", ".join(f"{k} {t}" for k, t in keys.items()), {k: (lambda r, k=k: call(r).get(k)) for k in keys}, None)
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def judged(answers: DataFrame, model: Judge) -> DataFrame:
    """answers with llm_accuracy; a blank prediction is wrong without a call."""
    from quillgraph.functions import text as T

    said = _mapped(answers, "said string", {"said": lambda r: model.judge(r["question"], r["ground_truth"], r["prediction"]) if (r["prediction"] or "").strip() else None}, None)
    return said.withColumn("llm_accuracy", T.verdict("prediction", "said")).drop("said")


def resolve_clusters(clusters: DataFrame, model: GroupResolver, workers: int | None = 5) -> DataFrame:
    """Groups (canonical_name, members, description) of clusters (cluster, members); any error is retried and then gives no groups."""

    def call(row: dict) -> list[dict]:
        try:
            return retried(lambda: model.resolve(list(row["members"])), on=(Exception,))
        except Exception:  # a cluster that can't be resolved stays as it is
            return []

    schema = "groups array<struct<canonical_name:string,members:array<string>,description:string>>"
    return _mapped(clusters.select("cluster", "members"), schema, {"groups": call}, workers).select(F.explode("groups").alias("g")).select("g.*")
