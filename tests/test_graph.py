import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators import graph as G
from quillgraph.operators import ingest
from quillgraph.operators.components import connected_components
from quillgraph.operators.paths import all_paths, collect_paths, deduplicate_paths
from quillgraph.operators.retrieve import Settings, all_cosines, nearest, propagate, retrieve, seeds, seeds_stateful, top_entities, vector_only
from quillgraph.storage import hinted, table_bytes

# a-b both ways, a loop, c without a vector, f far off
VECTORS = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": None, "d": [-1.0, 0.1], "e": [0.6, 0.8], "f": [0.0, 0.0]}
EDGES = [("a", "b", "r1"), ("b", "a", "r2"), ("a", "a", "loop"), ("a", "c", "r3"), ("a", "d", "r4"), ("b", "e", "r5"), ("e", "f", "r6")]


@pytest.fixture(scope="module")
def graph(spark):
    entities = spark.createDataFrame([(n, "T", f"about {n}", v) for n, v in VECTORS.items()], "name string, type string, description string, description_embedding array<double>")
    return entities, spark.createDataFrame(EDGES, "src string, dst string, relation string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")


ASK = "qid string, pos int, name string, hint_embedding array<double>"


def cos(x, y):
    n = (sum(a * a for a in x) * sum(a * a for a in y)) ** 0.5
    return sum(a * b for a, b in zip(x, y)) / n if n else 0.0


def plain_step(state, q, decay, threshold, gated):
    links = [(s, d) for s, d, _ in EDGES] + [(d, s) for s, d, _ in EDGES]
    gain = {}
    for s, d in links:
        if s != d and state.get(s, 0) > threshold and (d not in state or state[d] < state[s]) and (not gated or VECTORS[d] is not None):
            gain[d] = gain.get(d, 0) + state[s] * decay * (max(0.0, cos(VECTORS[d], q)) if gated else 1)
    return state | {d: state.get(d, 0) + g for d, g in gain.items() if g > threshold}


@pytest.mark.parametrize("gated", [True, False])
@pytest.mark.parametrize("decay, threshold", [(0.7, 0.01), (0.5, 0.4), (0.0, 0.01)])
def test_propagation(spark, graph, questions, gated, decay, threshold):
    entities, relations = graph
    state = {"a": 1.0, "e": 0.2}
    start = spark.createDataFrame([("q", n, r) for n, r in state.items()], "qid string, name string, resource double")
    for steps in (1, 2, 3):
        state = plain_step(state, [1.0, 0.0], decay, threshold, gated)
        got = {r.name: r.resource for r in propagate(start, G.adjacency(relations), questions, entities, steps, decay, threshold, gated).collect()}
        assert got == pytest.approx(state)
    if decay == 0.0:
        assert set(got) == {"a", "e"}


def test_exact_threshold_and_equal_resource_stop(spark, graph, questions):
    entities, relations = graph
    start = spark.createDataFrame([("q", "e", 0.5), ("q", "b", 0.5)], "qid string, name string, resource double")
    got = {r.name: r.resource for r in propagate(start, G.adjacency(relations), questions, entities, 1, 0.5, 0.5, False).collect()}
    assert got == {"e": 0.5, "b": 0.5}


def test_adjacency(graph):
    rows = [tuple(r) for r in G.adjacency(graph[1]).collect()]
    assert ("a", "b", "r1", True) in rows and ("a", "b", "r2", False) in rows and len(rows) == 12


def test_seeds(spark, graph):
    entities, _ = graph
    ask = spark.createDataFrame([("x", 0, "a", [1.0, 0.0]), ("x", 1, "zz", [0.6, 0.8]), ("y", 0, "A", [0.8, 0.6]), ("z", 0, "a", None), ("z", 1, "a", None)], ASK)
    got = {(r.qid, r.name): r.resource for r in seeds(ask, entities, 5).collect()}
    assert got["x", "a"] == 1.0 and got["x", "e"] == pytest.approx(1.0) and ("x", "b") in got and len([k for k in got if k[0] == "x"]) == 3
    assert [k for k in got if k[0] == "z"] == [("z", "a")] and max(v for k, v in got.items() if k[0] == "y") == 1.0 and ("y", "b") in got
    stateful = {(r.qid, r.name) for r in seeds_stateful(ask, entities, 2).collect()}
    assert {k for k in stateful if k[0] == "x"} == {("x", "a")} and len([k for k in stateful if k[0] == "y"]) == 2
    assert seeds(ask.limit(0), entities).count() == 0


def test_nearest_against_all(spark):
    rng = random.Random(1)
    rows = [(f"n{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [("dup1", [1.0] * 8), ("dup2", [1.0] * 8), ("zero", [0.0] * 8)]
    entities = spark.createDataFrame(rows, "name string, description_embedding array<double>").repartition(7)
    asked = [(f"q{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(5)] + [("tie", [1.0] * 8), ("none", None), ("zero", [0.0] * 8)]
    got = nearest(spark.createDataFrame(asked, "qid string, embedding array<double>"), entities, 7).collect()
    for qid, v in asked[:6]:
        want = sorted(((-(1 + cos(e, v)) / 2, n) for n, e in rows if n != "zero"))[:7]
        mine = sorted((r for r in got if r.qid == qid), key=lambda r: r.rank)
        assert [r.score for r in mine] == pytest.approx([-s for s, _ in want])
    assert [r.name for r in sorted((r for r in got if r.qid == "tie"), key=lambda r: r.rank)][:2] == ["dup1", "dup2"]
    assert not {"none", "zero"} & {r.qid for r in got}


def test_all_cosines(spark, monkeypatch):
    """Every pair, null ones too, digit by digit as by expressions, whatever the sizes of groups, tasks and blocks."""
    rng = random.Random(5)
    odd = [None, [0.0] * 6, [], [1.0] * 3, [0.5, -1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1e-200] * 6]
    some = lambda n: [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n)] + odd
    entities = spark.createDataFrame([(f"n{i}", v) for i, v in enumerate(some(40))], "name string, description_embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v, i) for i, v in enumerate(some(12))], "qid string, embedding array<double>, kept int")
    want = sorted(repr(tuple(r)) for r in entities.crossJoin(asked).select("qid", "kept", "name", F.round(V.cosine("description_embedding", "embedding"), 6)).collect())
    assert sorted(repr(tuple(r)) for r in all_cosines(asked, entities, 6).collect()) == want and len(want) == 49 * 21
    import quillgraph.operators.retrieve as R

    for name, n in (("QUERY_ROWS", 8), ("TASK_PAIRS", 100), ("HELD_PAIRS", 40)):
        monkeypatch.setattr(R, name, n)
    assert sorted(repr(tuple(r)) for r in all_cosines(asked, entities, 6).collect()) == want
    assert all_cosines(asked.limit(0), entities, 6).count() == 0 == all_cosines(asked, entities.limit(0), 6).count()


def test_cosine_scores_are_spread(spark, monkeypatch):
    """The query's tasks follow the pairs, not the files of the vectors: 500 entities and 5 questions, 500 pairs a task."""
    import quillgraph.operators.retrieve as R
    from quillgraph.plans.catalogue import QUERIES

    monkeypatch.setattr(R, "TASK_PAIRS", 500, raising=False)
    got = QUERIES["cosine_scores"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == 5 and sum(r["count"] for r in got) == 2500 and max(r["count"] for r in got) <= 1000


def plain_paths(state, start):
    links = [(s, d, r, True) for s, d, r in EDGES if s != d] + [(d, s, r, False) for s, d, r in EDGES if s != d]
    out, walk = [], [([n], [], state[n]) for n in start if n in state]
    for _ in range(4):
        walk = [(ns + [d], es + [(r, f)], t + state[d]) for ns, es, t in walk for s, d, r, f in links if s == ns[-1] and d in state and d not in ns]
        out += [(tuple(ns), tuple(es), t / len(ns)) for ns, es, t in walk]
    return out


def test_paths(spark, graph):
    state = {"a": 1.0, "b": 0.9, "c": 0.3, "e": 0.5}
    rows = spark.createDataFrame([("q", n, r) for n, r in state.items()], "qid string, name string, resource double")
    start = rows.where("name IN ('a', 'e')")
    edges = G.adjacency(graph[1])
    got = sorted((tuple(r["names"]), tuple((e.relation, e.forward) for e in r.edges), round(r.path_weight, 9)) for r in all_paths(rows, start, edges).collect())
    assert got == sorted((n, e, round(w, 9)) for n, e, w in plain_paths(state, ["a", "e"]))
    top = collect_paths(rows, start, edges, 3).orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2, 3] and top[0].path_weight >= top[1].path_weight >= top[2].path_weight


def plain_dedup(rows):
    seen, kept = set(), []
    for n in rows:
        if n in seen or n[::-1] in seen:
            continue
        seen.add(n)
        kept.append(n)
    inside = lambda s, x: len(s) < len(x) and (x[: len(s)] == s or x[-len(s) :] == s[::-1])
    return [n for n in kept if not any(inside(n, o) for o in kept)]


def test_path_dedup(spark):
    rng = random.Random(2)
    lists = {f"q{k}": [tuple(rng.sample("abcd", rng.randint(2, 4))) for _ in range(12)] for k in range(40)}
    rows = [(q, i + 1, list(n), [], 1.0) for q, ns in lists.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "qid string, rank int, names array<string>, edges array<struct<relation:string,forward:boolean>>, path_weight double")
    once = deduplicate_paths(df).collect()
    for q, ns in lists.items():
        assert [tuple(r["names"]) for r in sorted((r for r in once if r.qid == q), key=lambda r: r.rank)] == plain_dedup(ns)
    assert deduplicate_paths(deduplicate_paths(df)).count() == len(once)


def test_retrieve_modes(spark, graph, questions):
    entities, relations = graph
    both = questions.union(spark.createDataFrame([("none", [0.0, 1.0])], questions.schema))
    ask = spark.createDataFrame([("q", 0, "a", [1.0, 0.0])], ASK)
    r = retrieve(both, ask, entities, relations)
    assert {x.qid: x.steps_taken for x in r.steps_taken.collect()} == {"q": 3, "none": 0}
    assert {x.qid for x in r.entities.collect()} == {"q"} and r.paths.count() > 0
    s = retrieve(both, ask, entities, relations, Settings(mode="stateful", max_steps=4, decay=0.0))
    assert {x.qid: x.steps_taken for x in s.steps_taken.collect()} == {"q": 1, "none": 0}
    v = retrieve(both, ask, entities, relations, Settings(naive_vector=True, top_k_entities=2))
    assert v.entities.count() == 4 and v.paths.count() == v.seeds.count() == 0
    assert vector_only(questions, entities, 1).first().name == "a"
    same = retrieve(both.repartition(5), ask, entities.repartition(3), relations.repartition(4))
    assert sorted(map(str, same.entities.collect())) == sorted(map(str, r.entities.collect()))
    with pytest.raises(ValueError):
        Settings(mode="other")
    assert Settings("x", max_steps=2, query_aware=False).describe() == "[x] steps=2, decay=0.7, uniform, threshold=0.01"
    assert Settings("y", naive_vector=True).describe() == "[y] naive vector search, top_k=30"


def test_top_entities(spark, graph):
    state = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.1)], "qid string, name string, resource double")
    assert [(r["rank"], r.name) for r in top_entities(state, graph[0], 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (None, 1), (1, None)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    low = {}
    for n in parent:
        low[find(n)] = min(n, low.get(find(n), n))
    assert got == {n: low[find(n)] for n in parent}
    joined = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int"), broadcast_bytes=-1).collect()}
    assert joined == got
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_hub_component(spark):
    """A hub in the middle of the order, so that its minimum has to reach all its neighbours; sent out and joined."""
    edges = spark.range(3000).select(F.lit(1500).alias("src"), F.col("id").alias("dst"))
    for limit in (1 << 20, -1):
        found = connected_components(edges, broadcast_bytes=limit)
        assert found.count() == 3000 and found.where("component <> 0").count() == 0


def test_hinted(spark):
    df = spark.createDataFrame([("a", [1.0] * 100, 1, (2, "xy"))] * 10, "s string, v array<double>, i int, t struct<a:int,b:string>")
    size = table_bytes(df)
    assert 8000 < size < 10_000 and table_bytes(df.limit(0)) == 0
    plan = lambda limit: hinted(df, limit)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(size).lower() and "broadcast" not in plan(size - 1).lower()


def test_resources_do_not_follow_the_order_of_sums(spark, graph, questions):
    """0.1 + 0.2 and 0.3 are one resource: neither passes anything to the other, whichever was summed first."""
    entities, _ = graph
    links = spark.createDataFrame([("x", "s", "r"), ("y", "s", "r"), ("s", "t", "r")], "src string, dst string, relation string")
    start = spark.createDataFrame([("q", "x", 0.1), ("q", "y", 0.2), ("q", "t", 0.3)], "qid string, name string, resource double")
    edges = G.adjacency(links)
    after = propagate(start, edges, questions, entities, 1, 1.0, 0.05, False)
    assert {r.name: r.resource for r in after.collect()} == {"x": 0.1, "y": 0.2, "t": 0.3, "s": 0.6}
    mid = spark.createDataFrame([("q", "s", 0.1 + 0.2), ("q", "t", 0.3)], "qid string, name string, resource double")
    still = {r.name: r.resource for r in propagate(mid, edges, questions, entities, 1, 0.1, 0.05, False).where("name IN ('s', 't')").collect()}
    assert still == {"s": 0.3, "t": 0.3}


def test_nearest_in_blocks(spark, monkeypatch):
    """Small blocks and groups of queries give what one product of all gives."""
    rng = random.Random(21)
    entities = spark.createDataFrame([(f"n{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "name string, description_embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(9)], "qid string, embedding array<double>")
    whole = sorted(tuple(r) for r in nearest(asked, entities, 5).collect())
    import quillgraph.operators.retrieve as R

    monkeypatch.setattr(R, "QUERY_ROWS", 4)
    assert sorted(tuple(r) for r in nearest(asked, entities, 5).collect()) == whole


EXAMPLES = [
    (0, "q?", "a", [("T", "Alpha Beta met gamma.", True), ("U", "Nothing here.", False), ("T", "Alpha Beta met gamma.", True)]),
    (1, "r?", "b", [("T", "Another text.", False), (None, None, None)]),
]
EX_SCHEMA = "seq bigint, question string, answer string, paragraphs array<struct<title:string,text:string,is_supporting:boolean>>"
EXTRACTED = [
    ("T", [("Alpha  Beta", "person", " first "), ("Gamma", None, "g"), ("Alpha Beta", "PLACE", "fir"), ("  ", "X", "y")], [("Alpha Beta", "Met", "Gamma"), ("Alpha Beta", "met ", "gamma"), ("", "r", "late"), ("gamma", "is", "gamma")]),
    ("U", None, None),
]


def test_build_graph(spark, tmp_path):
    ex = spark.createDataFrame(EXAMPLES, EX_SCHEMA)
    found = spark.createDataFrame(EXTRACTED, "title string, entities array<struct<name:string,type:string,description:string>>, triples array<struct<subject:string,relation:string,object:string>>")
    g = ingest.build_graph(ex, found)
    entities = {r.name: (r.type, r.description, r.doc_count) for r in g.entities.collect()}
    assert entities["alpha beta"] == ("PERSON", "first", 1) and entities["gamma"][:2] == (None, "g") and entities[""][0] is None and entities["late"] == (None, None, 0)
    assert {(r.src, r.dst): r.relation for r in g.relations.collect()} == {("alpha beta", "gamma"): "met", ("", "late"): "r", ("gamma", "gamma"): "is"}
    kinds = {(r.source_kind, r.entity_name) for r in g.mentions.collect()}
    assert ("paragraph", "gamma") in kinds and ("document", "alpha beta") in kinds and ("paragraph", "") in kinds
    assert "" not in {r.name for r in ingest.build_graph(ex, found, skip_blank=True).entities.collect()}
    truth = ingest.ground_truth(ex).orderBy("question_id").collect()
    assert [r.question_id for r in truth] == ["q_0", "q_1"] and len(truth[0].supporting_paragraphs) == 2
    g.write(str(tmp_path))
    assert ingest.Graph.read(spark, str(tmp_path)).stats().count() == 6
    assert ingest.merged_documents(ingest.explode_paragraphs(ex)).where("title = 'T'").first().doc_text == "**T**\nAlpha Beta met gamma.\nAnother text."
    again = g.entities.withColumn("description_hash", F.lit("x"))
    assert ingest.pending_embeddings(again).count() == 2


def test_write_back(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", None, "n")], "k string, v int, w string")
    assert sorted(tuple(r) for r in G.write_back(rows, new, "k", ["v", "w"]).collect()) == [("a", None, "n"), ("b", 2, None)]
