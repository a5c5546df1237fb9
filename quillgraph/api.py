"""The engine as objects: load examples, retrieve for questions, answer, evaluate configurations, trace.

Every method works on all rows of a table at once and returns tables; single questions are tables of one row.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillgraph import models as M
from quillgraph.operators import context, evaluate, ingest, resolve, retrieve, trace
from quillgraph.operators.graph import adjacency, write_back
from quillgraph.operators.retrieve import Retrieval, Settings
from quillgraph.session import ship
from quillgraph.storage import cut


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache kept as Parquet; empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


class GraphLoader:
    """Builds and stores the graph under path: extraction per title, upserts, mentions, counts, embeddings, ground truth."""

    def __init__(self, spark: SparkSession, path: str, extractor: M.Extractor | None = None, embedder: M.Embedder | None = None, resolver: M.GroupResolver | None = None, model: str = "stub"):
        ship(spark)
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.extractor, self.embedder, self.resolver = extractor or M.StubExtractor(), embedder or M.StubEmbedder(), resolver

    def _cache(self, name: str, schema: str) -> DataFrame:
        return read_cache(self.spark, f"{self.path}/cache/{name}", schema)

    def extract(self, examples: DataFrame, max_extraction_workers: int = 3, save_every: int = 10_000) -> DataFrame:
        """Normalised extractions (title, entities, triples) of merged documents; only documents that the cache misses are asked for.

        About save_every documents at a time are asked for and added to the cache, so that a run that breaks off loses those of one batch at most.
        """
        keyed = cut(ingest.cache_key(ingest.merged_documents(ingest.explode_paragraphs(examples)), self.model))
        schema = f"cache_key string, {M.EXTRACTION}"
        missing = cut(ingest.cache_misses(keyed, self._cache("extractions", schema)))
        batches = max(1, -(-missing.count() // save_every))
        for b in range(batches):
            own = missing if batches == 1 else missing.where(F.pmod(F.xxhash64("cache_key"), F.lit(batches)) == b)
            M.extract(own, self.extractor, max_extraction_workers).select("cache_key", "entities", "triples").write.mode("append").parquet(f"{self.path}/cache/extractions")
        found = keyed.select("title", "cache_key").join(self._cache("extractions", schema), "cache_key").drop("cache_key")
        return cut(ingest.normalize_extractions(found))

    def resolve(self, extractions: DataFrame) -> DataFrame:
        """Extractions with the resolver's canonical names; off unless a resolver was given."""
        e = extractions.select(F.col("title").alias("extraction"), F.posexplode("entities").alias("pos", "e")).select("extraction", "pos", "e.*")
        t = extractions.select(F.col("title").alias("extraction"), F.posexplode("triples").alias("pos", "t")).select("extraction", "pos", "t.*")
        named = resolve.dominant_types(e.withColumn("seq", F.struct("extraction", "pos")))
        groups = cut(resolve.valid_groups(M.resolve_clusters(resolve.clusters(resolve.subset_pairs(named)), self.resolver)))
        aliases = resolve.alias_map(groups)
        again = lambda rows, *fields: rows.groupBy(F.col("extraction").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias("a"))
        entities = again(resolve.apply_entities(e, aliases, resolve.canonical_descriptions(groups)), "name", "type", "description").withColumnRenamed("a", "entities")
        triples = again(resolve.apply_triples(t, aliases), "subject", "relation", "object").withColumnRenamed("a", "triples")
        empty = lambda c: F.when(F.col(f"{c}_was").isNull(), None).otherwise(F.coalesce(c, F.slice(f"{c}_was", 1, 0))).alias(c)
        was = extractions.select("title", F.col("entities").alias("entities_was"), F.col("triples").alias("triples_was"))
        return was.join(entities, "title", "left").join(triples, "title", "left").select("title", empty("entities"), empty("triples"))

    def load_examples(self, examples: DataFrame, max_extraction_workers: int = 3, max_embedding_workers: int = 5, save_every: int = 10_000) -> DataFrame:
        """Writes all tables, in place of those of an earlier load, and returns the ground truth."""
        extractions = self.extract(examples, max_extraction_workers, save_every)
        if self.resolver is not None:
            extractions = cut(self.resolve(extractions))
        graph = ingest.build_graph(examples, extractions)
        pending = cut(ingest.pending_embeddings(graph.entities))
        vectors = self._embedded(pending.select(F.col("new_text").alias("text")), max_embedding_workers)
        updates = pending.join(vectors, pending["new_text"] == vectors["text"]).select("name", F.col("new_hash").alias("description_hash"), F.col("embedding").alias("description_embedding"))
        replace(graph, entities=write_back(graph.entities, updates, "name", ["description_hash", "description_embedding"])).write(f"{self.path}/graph")
        return ingest.ground_truth(examples)

    def embed_paragraphs(self, max_workers: int = 5) -> DataFrame:
        """The stored paragraphs with text_hash and embedding, written as paragraphs_embedded."""
        stored = self.graph().paragraphs
        pending = cut(ingest.pending_paragraphs(stored))
        vectors = self._embedded(pending.select(F.col("new_text").alias("text")), max_workers)
        updates = pending.join(vectors, pending["new_text"] == vectors["text"]).select("id", F.col("new_hash").alias("text_hash"), "embedding")
        write_back(stored, updates, "id", ["text_hash", "embedding"]).write.mode("overwrite").parquet(f"{self.path}/graph/paragraphs_embedded")
        return self.spark.read.parquet(f"{self.path}/graph/paragraphs_embedded")

    def _embedded(self, texts: DataFrame, workers: int) -> DataFrame:
        vectors, fresh = M.embed_cached(texts, self._cache("embeddings", "key string, embedding array<double>"), self.embedder, self.model, workers)
        vectors = cut(vectors)
        fresh.write.mode("append").parquet(f"{self.path}/cache/embeddings")
        return vectors

    def graph(self) -> ingest.Graph:
        return ingest.Graph.read(self.spark, f"{self.path}/graph")

    def get_stats(self) -> DataFrame:
        return self.graph().stats()


class Retriever:
    """Retrieval over stored tables; mode "stateful" in settings has the other form's seeds, stop and limits.

    With query_entity_cache, a folder, query entities and embeddings of questions asked before are read from there, and new ones added.
    """

    def __init__(
        self, entities: DataFrame, relations: DataFrame, settings: Settings = Settings(), asker: M.QuestionEntities | None = None,
        embedder: M.Embedder | None = None, query_entity_cache: str | None = None, model: str = "stub",
    ):
        ship(entities.sparkSession)
        self.entities, self.relations, self.settings = entities, relations, settings
        self.asker, self.embedder = asker or M.StubQuestionEntities(), embedder or M.StubEmbedder()
        self.cache, self.model = query_entity_cache, model

    def _embedded(self, texts: DataFrame) -> DataFrame:
        """(text, embedding) of the distinct texts."""
        if self.cache is None:
            return M.embed(texts, self.embedder, None)
        path = f"{self.cache.rstrip('/')}/embeddings"
        known = read_cache(texts.sparkSession, path, "key string, embedding array<double>")
        vectors, fresh = M.embed_cached(texts, known, self.embedder, self.model, None)
        vectors = cut(vectors)
        fresh.write.mode("append").parquet(path)
        return vectors

    def _found(self, questions: DataFrame) -> DataFrame:
        """(question, found) of the distinct questions."""
        asked = questions.select("question").where("question IS NOT NULL").distinct()
        if self.cache is None:
            return M.found_entities(asked, self.asker)
        path = f"{self.cache.rstrip('/')}/query_entities"
        known = read_cache(questions.sparkSession, path, f"question string, {M.FOUND}")
        fresh = cut(M.found_entities(asked.join(known.select("question"), "question", "left_anti"), self.asker))
        out = cut(asked.join(known.unionByName(fresh), "question"))
        fresh.write.mode("append").parquet(path)
        return out

    def prepare(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(qid, embedding) and the query entities (qid, pos, name, hint_embedding) of questions (qid, question)."""
        each = cut(M.listed_entities(questions, self._found(questions)))
        texts = questions.select(F.col("question").alias("text")).union(each.select("hint"))
        vectors = cut(self._embedded(texts))
        embedded = questions.join(vectors, questions["question"] == vectors["text"], "left").select("qid", "embedding")
        hints = vectors.withColumnRenamed("embedding", "hint_embedding")
        asked = each.join(hints, each["hint"] == hints["text"], "left").select("qid", "pos", "name", "hint_embedding")
        return cut(embedded), cut(asked)

    def retrieve(self, questions: DataFrame) -> Retrieval:
        return retrieve.retrieve(*self.prepare(questions), self.entities, self.relations, self.settings)

    def trace(self, questions: DataFrame, step: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(seeds, flows about to propagate, state) after so many steps."""
        s, (q, a) = self.settings, self.prepare(questions)
        seeds = cut(retrieve.seeds(a, self.entities, s.seed_vector_fallback_k))
        edges = adjacency(self.relations)
        state = retrieve.propagate(seeds, edges, q, self.entities, step, s.decay, s.resource_threshold, s.query_aware)
        return trace.trace_seeds(seeds), trace.trace_flows(state, edges, q, self.entities, s.decay, s.resource_threshold), trace.trace_state(state)


class AnswerAgent:
    """Answers from retrieved context, and scores against known answers."""

    def __init__(self, retriever: Retriever, generator: M.Generator | None = None, judge: M.Judge | None = None):
        self.retriever, self.generator, self.judge = retriever, generator or M.StubGenerator(), judge

    def answer(self, questions: DataFrame) -> tuple[DataFrame, Retrieval, DataFrame]:
        """Answers (qid, question, paths_text, descriptions_text, prediction, tokens, error, retrieval_s, generation_s), the retrieval and the query entities.

        Questions are retrieved and answered together, so a question's seconds are those of its batch divided by the number of questions.
        """
        n, began = max(questions.count(), 1), time.perf_counter()
        q, asked = self.retriever.prepare(questions)
        result = retrieve.retrieve(q, asked, self.retriever.entities, self.retriever.relations, self.retriever.settings)
        result = replace(result, paths=cut(result.paths), entities=cut(result.entities))
        texts = cut(questions.join(context.context_text(questions, result.paths, result.entities), "qid"))
        retrieved = time.perf_counter()
        answers = cut(M.answer(texts, self.generator))
        seconds = {"retrieval_s": F.lit((retrieved - began) / n), "generation_s": F.lit((time.perf_counter() - retrieved) / n)}
        return answers.withColumns(seconds), result, asked

    def evaluate(self, questions: DataFrame) -> DataFrame:
        """The 18 columns of an evaluation row for questions (qid, question, ground_truth); questions whose answer failed are left out."""
        answers, result, asked = self.answer(questions)
        scored = evaluate.score(answers.where("error IS NULL"))
        if self.judge is not None:
            scored = M.judged(scored, self.judge)
        return evaluate.evaluation_rows(scored.withColumnRenamed("qid", "question_id"), result, asked)


@dataclass(frozen=True)
class RunResult:
    settings: Settings
    rows: DataFrame
    report_every: int = 25

    def means(self) -> DataFrame:
        return evaluate.summary(self.rows.withColumn("config", F.lit(self.settings.name)))

    def progress(self) -> DataFrame:
        """The mean scores so far at every report_every-th question, in the questions' order."""
        return evaluate.running(self.rows.withColumn("seq", evaluate.question_number("question_id")), self.report_every)


class AblationEvaluator:
    """Runs configurations over the same questions (qid, question, ground_truth, and seq where their order isn't that of qid) and keeps each one's rows as CSV under path.

    Query entities and embeddings are kept in query_entity_cache_path, so that of several configurations only the first asks the models.
    """

    def __init__(
        self, entities: DataFrame, relations: DataFrame, questions: DataFrame, path: str, generator: M.Generator | None = None, judge: M.Judge | None = None,
        asker: M.QuestionEntities | None = None, embedder: M.Embedder | None = None, query_entity_cache_path: str | None = None,
    ):
        self.entities, self.relations, self.questions, self.path = entities, relations, questions, path.rstrip("/")
        self.generator, self.judge, self.asker, self.embedder = generator, judge, asker, embedder
        self.cache = query_entity_cache_path or f"{self.path}/_cache"  # readers of CSV pass over names with an underscore

    def _retriever(self, settings: Settings) -> Retriever:
        return Retriever(self.entities, self.relations, settings, self.asker, self.embedder, self.cache)

    def run_config(self, settings: Settings, n_eval: int | None = None, max_workers: int = 1, report_every: int = 25) -> RunResult:
        """Answers and scores the first n_eval questions, or all; rows are those of the written CSV."""
        evaluate.parallel_guard(max_workers, settings.mode)
        asked = evaluate.first_questions(self.questions, n_eval)
        evaluate.write_csv(AnswerAgent(self._retriever(settings), self.generator, self.judge).evaluate(cut(asked)), self.path, settings.name)
        rows = evaluate.read_csv(asked.sparkSession, self.path).where(F.col("config") == settings.name)
        return RunResult(settings, rows.drop("config"), report_every)

    def benchmark_retrieval(self, configs: Settings | list[Settings], n_eval: int | None = None, max_workers: int = 1, patch_csv: bool = True) -> list[dict]:
        """Seconds by configuration for the first n_eval questions, with embeddings and query entities ready beforehand.

        max_workers groups of questions are retrieved at once. With patch_csv, retrieval_s of the questions is replaced in the CSV of a configuration that has one.
        """
        configs = [configs] if isinstance(configs, Settings) else configs
        for c in configs:
            evaluate.parallel_guard(max_workers, c.mode)
        questions = cut(evaluate.first_questions(self.questions, n_eval))
        q, asked = self._retriever(Settings()).prepare(questions)
        out = evaluate.benchmark(q, asked, self.entities, self.relations, configs, max_workers)
        for row in out if patch_csv else []:
            timings = q.select(F.col("qid").alias("question_id"), F.lit(row["seconds_per_question"]).alias("retrieval_s"))
            row["patched"] = evaluate.patch_csv(self.path, row["config"], timings)
        return out

    def speedups(self, settings: Settings = Settings(), workers: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
        """(mode, workers, elapsed_s, speedup_vs_serial, matches_serial, questions): the same questions in so many groups at once, against one group."""
        q, asked = self._retriever(settings).prepare(self.questions)
        return evaluate.speedups(q, asked, self.entities, self.relations, settings, workers)

    def summary(self) -> DataFrame:
        return evaluate.summary(evaluate.read_csv(self.questions.sparkSession, self.path))
