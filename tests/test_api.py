import os
import socket
import sys
import tempfile
import time
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillgraph import AblationEvaluator, AnswerAgent, GraphLoader, Retriever, Settings
from quillgraph import models as M
from quillgraph.operators import evaluate, ingest, resolve
from quillgraph.permits import permits
from quillgraph.sources import qa

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below go to workers that can't import this file

EX = [
    (0, "Who met Gamma?", "Alpha", [("Alpha", "Alpha went with Gamma and Delta.", True), ("Delta", "Delta was seen by Omega.", False)]),
    (1, "Where is Omega?", "Delta", [("Omega", "Omega lives near Delta. Omega Prime too.", True)]),
]
EX_SCHEMA = "seq bigint, question string, answer string, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>"


class Counting(M.StubExtractor):
    def extract(self, text):
        if "Omega lives" in text:
            raise ValueError("bad document")
        return None if "Delta was" in text else super().extract(text)


def test_load_retrieve_answer_evaluate(spark, tmp_path):
    ex = spark.createDataFrame(EX, EX_SCHEMA)
    loader = GraphLoader(spark, str(tmp_path / "g"), extractor=Counting(), resolver=M.StubResolver())
    truth = loader.load_examples(ex)
    assert truth.count() == 2
    stats = {r.metric: r.value for r in loader.get_stats().collect()}
    assert stats["documents"] == 3 and stats["paragraphs"] == 3 and stats["entities"] >= 2
    loader.load_examples(ex)  # all extractions and embeddings come from the caches now
    assert {r.metric: r.value for r in loader.get_stats().collect()} == stats
    assert spark.read.parquet(str(tmp_path / "g/cache/extractions")).count() == 3
    assert loader.embed_paragraphs().where("embedding IS NOT NULL").count() == 3
    g = loader.graph()
    assert g.entities.where("description <> '' AND description_embedding IS NULL").count() == 0
    questions = truth.select(F.col("question_id").alias("qid"), "question", F.col("answer").alias("ground_truth"))
    rows = AnswerAgent(Retriever(g.entities, g.relations), judge=M.StubJudge()).evaluate(questions).collect()
    assert len(rows) == 2 and rows[0].asDict().keys() == {f.strip().split()[0] for f in evaluate.ROW_SCHEMA.split(",")}
    seeds, flows, state = Retriever(g.entities, g.relations).trace(questions, 1)
    assert seeds.count() > 0 and state.count() >= seeds.count() and flows.columns[0] == "qid"
    ev = AblationEvaluator(g.entities, g.relations, questions, str(tmp_path / "csv"))
    for s in (Settings("one", max_steps=1), Settings("vector", naive_vector=True)):
        assert ev.run_config(s, n_eval=2).means().first().n == 2
    assert {r.config for r in ev.summary().collect()} == {"one", "vector"}
    written = evaluate.read_csv(spark, str(tmp_path / "csv")).where("config = 'one'").collect()
    assert all(r.retrieval_s > 0 and r.generation_s > 0 for r in written)
    timed = ev.benchmark_retrieval([Settings("one", max_steps=1), Settings("never-run", max_steps=1)], n_eval=1)
    assert [(t["config"], t["questions"], t["patched"]) for t in timed] == [("one", 1, True), ("never-run", 1, False)]
    patched = {r.question_id: r.retrieval_s for r in evaluate.read_csv(spark, str(tmp_path / "csv")).where("config = 'one'").collect()}
    assert patched["q_0"] == pytest.approx(timed[0]["seconds_per_question"]) and patched["q_1"] == written[0].retrieval_s
    assert [(r.workers, r.matches_serial, r.questions) for r in ev.speedups(Settings(max_steps=1), (1, 2)).collect()] == [(1, 2, 2), (2, 2, 2)]
    assert ev.run_config(Settings("one", max_steps=1), report_every=1).progress().count() == 2
    # Both configurations, the benchmark and the table asked about two questions, and the model was asked once for each.
    assert spark.read.parquet(str(tmp_path / "csv/_cache/query_entities")).count() == 2
    with pytest.raises(ValueError):
        ev.run_config(Settings(mode="stateful"), max_workers=2)


def test_first_questions_and_batches(spark, tmp_path):
    q = spark.createDataFrame([(f"q_{i}",) for i in (10, 2, 0, 100, 1)] + [("other",)], "qid string")
    assert [r.qid for r in evaluate.first_questions(q, 3).collect()] == ["q_0", "q_1", "q_2"]
    assert evaluate.first_questions(q, None).count() == 6 and evaluate.first_questions(q, 6).collect()[-1].qid == "other"
    assert [r.qid for r in evaluate.first_questions(q.withColumn("seq", -F.length("qid")), 1).collect()] == ["q_100"]
    ex = spark.createDataFrame(EX, EX_SCHEMA)
    once = GraphLoader(spark, str(tmp_path / "a")).extract(ex).orderBy("title").collect()
    assert GraphLoader(spark, str(tmp_path / "b")).extract(ex, save_every=1).orderBy("title").collect() == once and len(once) == 3


class Failing:
    def generate(self, question, paths, descriptions):
        if "Omega" in question:
            raise RuntimeError("no answer")
        return {"prediction": "x", "prompt_tokens": 2, "completion_tokens": 1}


def test_failed_rows_are_left_out(spark):
    df = spark.createDataFrame([("a Omega", "p", "d"), ("b", "p", "d")], "question string, paths_text string, descriptions_text string")
    got = {r.question: (r.prediction, r.error, r.total_tokens) for r in M.answer(df, Failing()).collect()}
    assert got == {"a Omega": (None, "no answer", None), "b": ("x", None, 3)}


class Crowded:
    """Fails where more than most calls are at work, counted by files."""

    def __init__(self, folder, most):
        self.folder, self.most = folder, most

    def embed(self, text):
        with tempfile.NamedTemporaryFile(dir=self.folder):
            time.sleep(0.02)
            if len(os.listdir(self.folder)) > self.most:
                raise RuntimeError("too many at once")
        return [float(len(text))]


def test_calls_at_once_are_bounded_apart_from_partitions(spark, tmp_path):
    texts = spark.createDataFrame([("x" * i,) for i in range(1, 61)], "text string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = M.embed(texts, Crowded(str(tmp_path), 2), 2).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted(r.embedding[0] for r in got) == [float(i) for i in range(1, 61)]
    assert len({r.part for r in got}) == 12 and all(len([r for r in got if r.part == p]) <= 10 for p in range(12))
    with pytest.raises(Exception, match="too many at once"):
        M.embed(texts, Crowded(str(tmp_path), 2), 4).collect()


def test_permits(spark):
    """A permit comes back when it is given back, after an error and from a lost connection; a wrong key gets none."""
    p = permits(spark, 1)
    with p.asked() as held:
        with held():
            pass
        with pytest.raises(ZeroDivisionError), held():
            1 / 0
        with held():
            pass
    lost = socket.create_connection((p.host, p.port))
    lost.sendall(p.key + b"?")
    assert lost.recv(1) == b"!"
    waiting = socket.create_connection((p.host, p.port))
    waiting.sendall(p.key + b"?")
    waiting.settimeout(0.5)
    with pytest.raises(TimeoutError):
        waiting.recv(1)
    lost.close()
    waiting.settimeout(30)
    assert waiting.recv(1) == b"!"
    waiting.close()
    with replace(p, key=bytes(32)).asked() as held, pytest.raises(OSError), held():
        pass


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise M.Throttled
        return "done"

    assert M.retried(call, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    calls.clear(), waits.clear()
    assert M.retried(call, base=5.0, sleep=waits.append) == "done" and waits == [5.0, 10.0]
    with pytest.raises(ZeroDivisionError):
        M.retried(lambda: 1 / 0, sleep=waits.append)
    with pytest.raises(M.Throttled):
        M.retried(lambda: (_ for _ in ()).throw(M.Throttled()), tries=2, sleep=waits.append)


def test_resolution(spark):
    rows = [(1, "new york", "PLACE", "x" * 200), (2, "york", "PLACE", ""), (3, "york", "PERSON", "y"), (4, "york", "PERSON", "z"), (5, "york new", "PLACE", None), (6, "big new york", "PLACE", "b")]
    named = resolve.dominant_types(spark.createDataFrame(rows, "seq int, name string, type string, description string"))
    got = {r.name: (r.type, r.descriptions) for r in named.collect()}
    assert got["york"] == ("PERSON", ["y", "z"]) and got["new york"] == ("PLACE", ["x" * 120]) and got["york new"] == ("PLACE", [])
    pairs = {(r.a, r.b) for r in resolve.subset_pairs(named).collect()}
    assert pairs == {("new york", "york new"), ("big new york", "new york"), ("big new york", "york new")}
    assert [r.members for r in resolve.clusters(resolve.subset_pairs(named)).collect()] == [["big new york", "new york", "york new"]]
    groups = spark.createDataFrame([("New  York", ["New  York", "york new"], "d"), ("one", ["one"], "d"), ("p", ["q", "r"], "d"), ("q", ["q", "r"], " ")], "canonical_name string, members array<string>, description string")
    valid = resolve.valid_groups(groups)
    assert valid.count() == 1
    assert [tuple(r) for r in resolve.alias_map(valid).collect()] == [("york new", "new york", "d")]
    triples = spark.createDataFrame([("e", 0, "york new", "is", "new york"), ("e", 1, "york new", "in", "us"), ("e", 2, "york new", "in", "us")], "extraction string, pos int, subject string, relation string, object string")
    assert [r.subject for r in resolve.apply_triples(triples, resolve.alias_map(valid)).collect()] == ["new york"] * 2


def test_adapters(spark):
    pairs = "array<struct<title:string,sentences:array<string>>>"
    struct = "struct<title:array<string>,sentences:array<array<string>>>"
    facts = "struct<title:array<string>>"
    lists = spark.createDataFrame([(0, "q", ["a", "b"], (["T", "U", "V"], [[" one ", "", "two"], [" "]]), (["T", "T"],)), (1, "q", [], (["T"], [["x"]]), ([],)), (2, " ", ["a"], (["T"], [["x"]]), ([],)), (3, "q", ["a"], ([], []), ([],))], f"seq int, question string, answer array<string>, context {struct}, supporting_facts {facts}")
    got = qa.context_examples(lists).collect()
    assert [(r.seq, r.answer) for r in got] == [(0, "a")] and [tuple(p) for p in got[0].paragraphs] == [("T", "one two", True)]
    rows = spark.createDataFrame([(0, "q", "a", [("T", ["x"]), (" ", ["y"]), (None, ["z"])], [("T",)])], f"seq int, question string, answer string, context {pairs}, supporting_facts array<struct<title:string>>")
    assert [tuple(p) for p in qa.context_examples(rows).first().paragraphs] == [("T", "x", True)]
    assert qa.answerable(rows).count() == 1 and qa.answerable(rows.withColumn("answerable", F.lit(False))).count() == 0
    rows.createOrReplaceTempView("rows_for_query")
    assert qa.run_query(spark, "SELECT * FROM rows_for_query WHERE seq = :n", n=0).count() == 1


def test_caches_and_windows(spark):
    cache = spark.createDataFrame([("plain", 1), ("other", 2)], "key string, value int")
    moved = ingest.migrate_cache_keys(cache, "m")
    assert ingest.migrate_cache_keys(moved.union(cache.withColumn("value", F.lit(9))), "m").agg(F.sum("value")).first()[0] == 3
    rows = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(10)], "seq int, em double, f1 double")
    assert [r.em_trailing for r in evaluate.trailing(rows, 2).orderBy("seq").collect()][:3] == [0.0, 0.5, 0.5]
    assert [(r.done, r.em_running) for r in evaluate.running(rows, 5).orderBy("done").collect()] == [(5, 0.4), (10, 0.5)]
    lat = evaluate.latency(spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 10.0)], "config string, retrieval_s double")).first()
    assert lat.p95_s == pytest.approx(9.2) and lat.p50_s == 2.0
    judged = spark.createDataFrame([("a", 1.0, 1.0, None), ("a", 0.0, float("nan"), 1.0)], "config string, em double, f1 double, llm_accuracy double")
    s = evaluate.summary(judged).first()
    assert (s.em, s.f1, s.llm_acc) == (0.5, 1.0, 1.0)
