"""The named queries over the synthetic tables, one or more per operator, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillgraph import models as M
from quillgraph.functions import text as T
from quillgraph.operators import context, evaluate, graph, ingest, paths, resolve, retrieve, trace
from quillgraph.plans import fixtures as X
from quillgraph.sources import qa
from quillgraph.storage import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _6(c: str):
    return F.round(c, 6).alias(c)


# --- vectors, seeds, propagation

SIM = "list_dot_product(e.v, q.v) / nullif(e.nrm * q.nrm, 0)"
VSEED_SQL = f"""
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS rank FROM (SELECT q.qid, e.name, round((1 + {SIM}) / 2, 12) AS score FROM q CROSS JOIN entn e))
"""
SEED_SQL = f"""
asked AS (SELECT *, greatest(1, 5 // count(*) OVER (PARTITION BY qid)) AS k, name IN (SELECT name FROM ent) AS known FROM ask),
fallback AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY round(score, 9) DESC, name) AS rn FROM (
  SELECT a.qid, a.pos, a.k, e.name, round((1 + list_dot_product(e.v, a.v) / nullif(e.nrm * sqrt(list_dot_product(a.v, a.v)), 0)) / 2, 12) AS score
  FROM asked a CROSS JOIN entn e WHERE NOT a.known AND a.v IS NOT NULL)),
best AS (SELECT qid, name, max(score) AS score FROM (SELECT qid, name, 1.0 AS score FROM asked WHERE known UNION ALL SELECT qid, name, score FROM fallback WHERE rn <= k AND score IS NOT NULL) GROUP BY qid, name),
s0 AS MATERIALIZED (SELECT qid, name, round(score / max(score) OVER (PARTITION BY qid), 12) AS resource FROM best)
"""


def steps_sql(n: int, decay: float = 0.7, gated: bool = True, threshold: float = 0.01) -> str:
    out = []
    for i in range(1, n + 1):
        gate = f"round(t.total * CASE WHEN {SIM} > 0 THEN {SIM} ELSE 0 END, 12)"
        gain = f"SELECT t.qid, t.name, {gate} AS inc FROM t{i} t JOIN entn e ON e.name = t.name JOIN q ON q.qid = t.qid WHERE e.v IS NOT NULL" if gated else f"SELECT qid, name, total AS inc FROM t{i}"
        out.append(f"""
t{i} AS MATERIALIZED (SELECT a.qid, x.dst AS name, round(sum(a.resource) * {decay}, 12) AS total FROM s{i - 1} a JOIN adj x ON x.src = a.name LEFT JOIN s{i - 1} b ON b.qid = a.qid AND b.name = x.dst
  WHERE a.resource > {threshold} AND (b.resource IS NULL OR b.resource < a.resource) GROUP BY a.qid, x.dst),
g{i} AS MATERIALIZED ({gain}),
s{i} AS MATERIALIZED (SELECT qid, name, round(sum(resource), 12) AS resource FROM (SELECT qid, name, resource FROM s{i - 1} UNION ALL SELECT qid, name, inc FROM g{i} WHERE inc > {threshold}) GROUP BY qid, name)""")
    return ",".join(out)


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p for p in parts if p) + "\n"


def _start(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(seeds, edges, questions, entities)."""
    e = X.entities(spark, d)
    return cut(retrieve.seeds(X.query_entities(spark, d), e)), cut(graph.adjacency(X.relations(spark, d))), X.questions(spark, d), e


def _state(spark: SparkSession, d: str, steps: int = 3, decay: float = 0.7, gated: bool = True) -> tuple[DataFrame, ...]:
    seeds, edges, questions, entities = _start(spark, d)
    return retrieve.propagate(seeds, edges, questions, entities, steps, decay, gated=gated), seeds, edges, questions, entities


@query(_with(X.GRAPH_SQL) + f"SELECT q.qid, e.name, round({SIM}, 6) AS cos FROM q CROSS JOIN entn e")
def cosine_scores(spark, d):
    return retrieve.all_cosines(X.questions(spark, d), X.entities(spark, d), 6)


@query(_with(X.GRAPH_SQL, VSEED_SQL) + "SELECT qid, name, round(score, 6) AS score, rank FROM near WHERE rank <= 10")
def knn_topk(spark, d):
    return retrieve.nearest(X.questions(spark, d), X.entities(spark, d), 10).select("qid", "name", _6("score"), "rank")


@query(_with(X.GRAPH_SQL, VSEED_SQL) + "SELECT n.qid, n.rank, n.name, round(n.score, 6) AS resource, e.type, e.description FROM near n JOIN ent e ON e.name = n.name WHERE rank <= 30")
def naive_retrieve(spark, d):
    return retrieve.vector_only(X.questions(spark, d), X.entities(spark, d)).withColumn("resource", F.round("resource", 6))


@query(_with(X.GRAPH_SQL, SEED_SQL) + "SELECT qid, name, round(resource, 6) AS resource FROM s0")
def seeds_mixed(spark, d):
    return retrieve.seeds(X.query_entities(spark, d), X.entities(spark, d)).select("qid", "name", _6("resource"))


@query(
    _with(X.GRAPH_SQL)
    + """, hit AS (SELECT DISTINCT qid, name FROM ask WHERE name IN (SELECT name FROM ent)),
one AS (SELECT * FROM ask WHERE pos = 0 AND qid NOT IN (SELECT qid FROM hit)),
near AS (SELECT a.qid, e.name, round((1 + list_dot_product(e.v, a.v) / (e.nrm * sqrt(list_dot_product(a.v, a.v)))) / 2, 12) AS score FROM one a CROSS JOIN entn e),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS rn FROM near)
SELECT qid, name, 1.0 AS resource FROM hit UNION ALL SELECT qid, name, round(score / max(score) OVER (PARTITION BY qid), 6) FROM top WHERE rn <= 5"""
)
def seeds_stateful(spark, d):
    return retrieve.seeds_stateful(X.query_entities(spark, d), X.entities(spark, d)).select("qid", "name", _6("resource"))


@query(_with(X.GRAPH_SQL) + "SELECT src, dst, relation, forward FROM adj")
def adjacency(spark, d):
    return graph.adjacency(X.relations(spark, d))


def _propagation(name: str, steps: int, decay: float = 0.7, gated: bool = True) -> None:
    def run(spark, d):
        return _state(spark, d, steps, decay, gated)[0].select("qid", "name", _6("resource"))

    QUERIES[name] = run
    ORACLE_SQL[name] = _with(X.GRAPH_SQL, SEED_SQL, steps_sql(steps, decay, gated)) + f"SELECT qid, name, round(resource, 6) AS resource FROM s{steps}"


for _n in (1, 2, 3, 4):
    _propagation(f"propagate_gated_{_n}", _n)
for _n in (1, 3):
    _propagation(f"propagate_uniform_{_n}", _n, gated=False)
for _decay in (0.3, 0.5, 0.9, 1.0):
    _propagation(f"propagate_decay_{str(_decay).replace('.', '')}", 3, _decay)

STATE3 = _with(X.GRAPH_SQL, SEED_SQL, steps_sql(3))


@query(STATE3 + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3) SELECT r.qid, r.rank, r.name, round(r.resource, 6) AS resource, e.type, e.description FROM r JOIN ent e ON e.name = r.name WHERE rank <= 30")
def top_entities(spark, d):
    state, _, _, _, e = _state(spark, d)
    return retrieve.top_entities(state, e).withColumn("resource", F.round("resource", 6))


_HOP = """p{i} AS MATERIALIZED (SELECT p.qid, list_append(p.names, a.dst) AS names, list_append(p.rels, a.relation) AS rels, list_append(p.fwd, a.forward) AS fwd, p.total + a.res AS total, a.dst AS at_end
  FROM p{j} p JOIN act a ON a.qid = p.qid AND a.src = p.at_end WHERE NOT list_contains(p.names, a.dst))"""
PATH_SQL = (
    "act AS MATERIALIZED (SELECT a.qid, x.src, x.dst, x.relation, x.forward, b.resource AS res FROM s3 a JOIN adj x ON x.src = a.name JOIN s3 b ON b.qid = a.qid AND b.name = x.dst),"
    "p0 AS MATERIALIZED (SELECT s.qid, [s.name] AS names, CAST([] AS VARCHAR[]) AS rels, CAST([] AS BOOLEAN[]) AS fwd, t.resource AS total, s.name AS at_end FROM s0 s JOIN s3 t ON t.qid = s.qid AND t.name = s.name),"
    + ",".join(_HOP.format(i=i, j=i - 1) for i in range(1, 5))
    + ", every AS MATERIALIZED (SELECT qid, names, rels, fwd, total / len(names) AS w FROM ("
    + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, 5))
    + ")), toppaths AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w, 9) DESC, len(names), names, list_transform(fwd, lambda x: CAST(x AS INT)), rels) AS rank FROM every) WHERE rank <= 30)"
    ", once AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, least(names, list_reverse(names)) ORDER BY rank) AS o FROM toppaths) WHERE o = 1)"
    ", dedup AS MATERIALIZED (SELECT * FROM once a WHERE NOT EXISTS (SELECT 1 FROM once b WHERE b.qid = a.qid AND len(b.names) > len(a.names) AND (b.names[1:len(a.names)] = a.names OR list_reverse(b.names)[1:len(a.names)] = a.names)))"
)
_PATH_OUT = "qid, array_to_string(names, '>') AS path, array_to_string(rels, '>') AS relations, array_to_string(list_transform(fwd, lambda x: CASE WHEN x THEN 'f' ELSE 'b' END), '') AS directions, round(w, 6) AS path_weight"


def _paths_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "qid", *more, F.array_join("names", ">").alias("path"), F.array_join(F.transform("edges", lambda e: e["relation"]), ">").alias("relations"),
        F.array_join(F.transform("edges", lambda e: F.when(e["forward"], "f").otherwise("b")), "").alias("directions"), _6("path_weight"),
    )


@query(STATE3 + "," + PATH_SQL + f" SELECT {_PATH_OUT} FROM every")
def paths_raw(spark, d):
    state, seeds, edges, _, _ = _state(spark, d)
    return _paths_out(paths.all_paths(state, seeds, edges))


@query(STATE3 + "," + PATH_SQL + f" SELECT rank, {_PATH_OUT} FROM toppaths")
def paths_topk(spark, d):
    state, seeds, edges, _, _ = _state(spark, d)
    return _paths_out(paths.collect_paths(state, seeds, edges), "rank")


@query(STATE3 + "," + PATH_SQL + f" SELECT rank, {_PATH_OUT} FROM dedup")
def paths_dedup(spark, d):
    state, seeds, edges, _, _ = _state(spark, d)
    return _paths_out(paths.deduplicate_paths(cut(paths.collect_paths(state, seeds, edges))), "rank")


_CONTEXT_SQL = """, line AS (SELECT qid, rank, names[1] || array_to_string(list_transform(range(1, len(names)), lambda i: CASE WHEN fwd[i] THEN ' --[' || rels[i] || ']--> ' ELSE ' <--[' || rels[i] || ']-- ' END || '''' || names[i + 1] || ''''), '') AS t FROM dedup),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3),
dl AS (SELECT r.qid, r.rank, '- ' || e.name || ': ' || e.description AS t FROM r JOIN ent e ON e.name = r.name WHERE r.rank <= 30),
pt AS (SELECT qid, string_agg(t, chr(10) ORDER BY rank) AS p FROM line GROUP BY qid), dt AS (SELECT qid, string_agg(t, chr(10) ORDER BY rank) AS x FROM dl GROUP BY qid)
SELECT q.qid, coalesce(p, 'No paths found.') AS paths_text, coalesce(x, CASE WHEN p IS NULL THEN 'No entities found.' ELSE 'No descriptions available.' END) AS descriptions_text FROM q LEFT JOIN pt ON pt.qid = q.qid LEFT JOIN dt ON dt.qid = q.qid"""


@query(STATE3 + "," + PATH_SQL + _CONTEXT_SQL)
def context_text(spark, d):
    r = retrieve.retrieve(X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d))
    return context.context_text(X.questions(spark, d), r.paths, r.entities)


@query(
    _with(X.GRAPH_SQL, SEED_SQL, steps_sql(1))
    + f""", f AS (SELECT a.qid, a.name AS src, x.relation, x.dst, x.forward, {SIM} AS sim, a.resource * 0.7 * CASE WHEN {SIM} > 0 THEN {SIM} ELSE 0 END AS contrib
  FROM s1 a JOIN adj x ON x.src = a.name LEFT JOIN s1 b ON b.qid = a.qid AND b.name = x.dst JOIN entn e ON e.name = x.dst JOIN q ON q.qid = a.qid WHERE a.resource > 0.01 AND (b.resource IS NULL OR b.resource < a.resource)),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(contrib, 9) DESC, src, dst, forward, relation) AS rank FROM f WHERE contrib > 0)
SELECT qid, rank, src, relation, dst, forward, round(sim, 4) AS sim, round(contrib, 4) AS contrib FROM g WHERE rank <= 15"""
)
def trace_flows(spark, d):
    state, _, edges, questions, e = _state(spark, d, 1)
    return trace.trace_flows(state, edges, questions, e)


@query(STATE3 + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3) SELECT qid, rank, name, round(resource, 4) AS resource FROM r WHERE rank <= 20")
def trace_state(spark, d):
    return trace.trace_state(_state(spark, d)[0])


@query(_with(X.GRAPH_SQL, SEED_SQL) + "SELECT qid, name, round(resource, 4) AS resource FROM s0")
def trace_seeds(spark, d):
    return trace.trace_seeds(_start(spark, d)[0])


@query(STATE3 + ", c AS (SELECT a.qid, count(*) AS updated FROM s3 a LEFT JOIN s2 b ON b.qid = a.qid AND b.name = a.name WHERE b.resource IS NULL OR a.resource > b.resource GROUP BY a.qid) SELECT * FROM c")
def active_counts(spark, d):
    seeds, edges, questions, e = _start(spark, d)
    before = retrieve.propagate(seeds, edges, questions, e, 2)
    return trace.active_counts(before, retrieve.propagate(before, edges, questions, e, 1))


@query(
    STATE3 + "," + PATH_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3)
SELECT q.qid, (SELECT string_agg(name, ',' ORDER BY name) FROM s0 WHERE s0.qid = q.qid) AS seeds, (SELECT string_agg(name, ',' ORDER BY name) FROM r WHERE r.qid = q.qid AND rank <= 30) AS entities,
  coalesce((SELECT string_agg(array_to_string(names, '>'), ',' ORDER BY array_to_string(names, '>')) FROM dedup WHERE dedup.qid = q.qid), '') AS paths FROM q"""
)
def fingerprints(spark, d):
    r = retrieve.retrieve(X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d))
    f = evaluate.fingerprints(r, X.questions(spark, d))
    text = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.replace(x, F.lit("\x1f"), F.lit(">")))), ",").alias(c)
    return f.select("qid", text("seeds"), text("entities"), text("paths"))


@query("SELECT count(*) AS n, count(*) AS matches, true AS all_match FROM embeddings WHERE vec_id % 100 = 7")
def fingerprint_match(spark, d):
    """Questions one partition at a time and all at once give the same results."""
    q, a, e, r = X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d)
    one = evaluate.fingerprints(retrieve.retrieve(q, a, e, r), q)
    other = evaluate.fingerprints(retrieve.retrieve(q.repartition(7), a.repartition(5), e.repartition(9), r.repartition(3)), q)
    return evaluate.same_fingerprints(one, other)


@query(STATE3 + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3) SELECT qid, rank, name, round(resource, 6) AS resource, true AS same FROM r WHERE rank <= 30")
def partition_invariance(spark, d):
    """Ranks and resources from tables in other partitions; same tells that every digit is as it was."""
    q, a, e, r = X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d)
    one = retrieve.retrieve(q, a, e, r).entities.select("qid", "rank", F.struct("name", "resource").alias("was"))
    other = retrieve.retrieve(q.repartition(7), a.repartition(5), e.repartition(9), r.repartition(13, "dst")).entities
    return other.join(cut(one), ["qid", "rank"], "left").select("qid", "rank", "name", _6("resource"), (F.struct("name", "resource") == F.col("was")).alias("same"))


@query(
    "SELECT w.mode, w.workers, count(*) AS matches_serial, count(*) AS questions FROM embeddings CROSS JOIN (SELECT 'serial' AS mode, 1 AS workers UNION ALL SELECT 'parallel x3', 3) w WHERE vec_id % 100 = 7 GROUP BY w.mode, w.workers"
)
def parallel_speedup(spark, d):
    """The table of speed-ups without its times: how many questions of a parallel run give the serial results."""
    table = evaluate.speedups(X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d), retrieve.Settings(max_steps=1), (1, 3))
    return table.select("mode", "workers", "matches_serial", "questions")


@query(
    _with(X.GRAPH_SQL, VSEED_SQL, SEED_SQL, steps_sql(1))
    + "SELECT 'naive-vector' AS config, qid, count(*) AS n FROM near WHERE rank <= 30 GROUP BY qid UNION ALL SELECT 'steps-1', qid, least(count(*), 30) FROM s1 GROUP BY qid"
)
def ablation_sweep(spark, d):
    configs = [c for c in evaluate.ABLATION if c.name in ("naive-vector", "steps-1")]
    found = evaluate.sweep(X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d), configs)
    parts = [r.entities.groupBy("qid").agg(F.count("*").alias("n")).select(F.lit(name).alias("config"), "qid", "n") for name, r in found.items()]
    return parts[0].unionByName(parts[1])


_STATEFUL = {"decay": 0.3, "resource_threshold": 0.05, "max_steps": 4}
_STATEFUL_SQL = _with(
    X.GRAPH_SQL,
    """s0 AS MATERIALIZED (SELECT DISTINCT qid, name, 1.0::DOUBLE AS resource FROM ask WHERE name IN (SELECT name FROM ent) UNION ALL
  SELECT qid, name, round(score / max(score) OVER (PARTITION BY qid), 12) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, name) AS rn FROM (
    SELECT a.qid, e.name, round((1 + list_dot_product(e.v, a.v) / (e.nrm * sqrt(list_dot_product(a.v, a.v)))) / 2, 12) AS score FROM ask a CROSS JOIN entn e
    WHERE a.pos = 0 AND a.qid NOT IN (SELECT qid FROM ask WHERE name IN (SELECT name FROM ent)))) WHERE rn <= 5)""",
    steps_sql(4, _STATEFUL["decay"], True, _STATEFUL["resource_threshold"]),
)


def _stateful(spark: SparkSession, d: str) -> retrieve.Retrieval:
    settings = retrieve.Settings(mode="stateful", **_STATEFUL)
    return retrieve.retrieve(X.questions(spark, d), X.query_entities(spark, d), X.entities(spark, d), X.relations(spark, d), settings)


@query(_STATEFUL_SQL + "SELECT qid, name, round(resource, 6) AS resource FROM s4")
def stateful_state(spark, d):
    return _stateful(spark, d).state.select("qid", "name", _6("resource"))


@query(
    _STATEFUL_SQL.rstrip()
    + "".join(f", c{i} AS (SELECT DISTINCT a.qid FROM s{i} a LEFT JOIN s{i - 1} b ON b.qid = a.qid AND b.name = a.name WHERE b.resource IS NULL OR b.resource <> a.resource)" for i in range(1, 5))
    + " SELECT q.qid, CASE WHEN q.qid NOT IN (SELECT qid FROM s0) THEN 0 WHEN q.qid NOT IN (SELECT qid FROM c1) THEN 1 WHEN q.qid NOT IN (SELECT qid FROM c2) THEN 2 WHEN q.qid NOT IN (SELECT qid FROM c3) THEN 3 ELSE 4 END AS steps_taken FROM q"
)
def stateful_steps(spark, d):
    """A question stops at its first step that changes nothing."""
    return _stateful(spark, d).steps_taken


@query(
    STATE3 + "," + PATH_SQL + """ SELECT qid, rank, printf('[%.4f] ', w) || names[1] || array_to_string(list_transform(range(1, len(names)), lambda i: CASE WHEN fwd[i] THEN ' --[' || rels[i] || ']--> ' ELSE ' <--[' || rels[i] || ']-- ' END || names[i + 1]), '') AS line FROM toppaths"""
)
def weighted_paths(spark, d):
    state, seeds, edges, _, _ = _state(spark, d)
    return paths.collect_paths(state, seeds, edges).select("qid", "rank", T.weighted_path_text("names", "edges", "path_weight").alias("line"))


# --- text functions

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(r"SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 80)), '\s+', ' ', 'g')) AS name, upper(regexp_replace(lang, '^\s+|\s+$', '', 'g')) AS type, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS relation FROM documents")
def name_normalize(spark, d):
    docs = X.table(spark, d, "documents")
    return docs.select("doc_id", T.normalize_name(F.substring("text", 1, 80)).alias("name"), T.normalize_type("lang").alias("type"), T.normalize_relation("source").alias("relation"))


@query(
    r"""WITH c AS (SELECT p_partkey, string_split(lower(p_name) || ' o''neil 2nd mcdonald-smith', '') AS ch FROM part)
SELECT p_partkey, array_to_string(list_transform(ch, lambda x, i: CASE WHEN i > 1 AND regexp_matches(ch[i - 1], '\p{L}') THEN lower(x) ELSE upper(x) END), '') AS titled FROM c"""
)
def title_case(spark, d):
    p = X.table(spark, d, "part")
    return p.select("p_partkey", T.title_case(F.concat(F.lower("p_name"), F.lit(" o'neil 2nd mcdonald-smith"))).alias("titled"))


@query("SELECT DISTINCT source AS title, sha256(text) AS text_hash, source || '__' || substr(sha256(source || chr(10) || text), 1, 10) AS id FROM documents")
def paragraph_ids(spark, d):
    p = X.table(spark, d, "documents").select(F.col("source").alias("title"), "text")
    return ingest.distinct_paragraphs(p).select("title", T.sha256("text").alias("text_hash"), "id")


@query(r"SELECT doc_id, '**' || source || '**: ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS canonical FROM documents")
def canonical_paragraph(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.canonical_paragraph("source", "text").alias("canonical"))


@query(
    r"""WITH s AS (SELECT conv_id, list_filter(list_transform(string_split(replace(string_agg(role || ' ' || turn % 3, ' | ' ORDER BY turn), 'user 1', ''), ' | '), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort(list_distinct(p)), ' | ') AS description FROM s"""
)
def canonical_description(spark, d):
    c = X.table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" "), (F.col("turn") % 3).cast("string")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), " | ")
    return c.groupBy("conv_id").agg(F.replace(text, F.lit("user 1"), F.lit("")).alias("x")).select("conv_id", T.canonical_description("x").alias("description"))


# --- ingestion

TEXT = _with(X.TEXT_SQL)


def _ingested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, paragraphs, normalized extractions)."""
    ex = cut(X.examples(spark, d))
    p = ingest.explode_paragraphs(ex)
    return ex, p, cut(ingest.normalize_extractions(X.extractions(ingest.merged_documents(p))))


@query(TEXT + "SELECT title, sha256(doc_text) AS doc_hash, length(doc_text) AS size FROM merged")
def merged_documents(spark, d):
    p = ingest.explode_paragraphs(X.examples(spark, d))
    return ingest.merged_documents(p).select("title", T.sha256("doc_text").alias("doc_hash"), F.length("doc_text").cast("bigint").alias("size"))


@query(TEXT + "SELECT title, i, name, type, description FROM ents")
def extraction_normalize(spark, d):
    _, _, x = _ingested(spark, d)
    return x.select("title", F.posexplode("entities").alias("i", "e")).select("title", F.col("i").cast("bigint").alias("i"), "e.*")


@query(TEXT + "SELECT name, type, description FROM entity")
def entity_upsert(spark, d):
    _, p, x = _ingested(spark, d)
    return graph.upsert_entities(ingest.entity_rows(p, x))


@query(TEXT + "SELECT src, dst, relation FROM relation")
def relation_upsert(spark, d):
    _, p, x = _ingested(spark, d)
    return graph.upsert_relations(ingest.relation_rows(p, x), graph.upsert_entities(ingest.entity_rows(p, x)))


@query(TEXT + "SELECT * FROM pmention")
def mentions(spark, d):
    _, p, x = _ingested(spark, d)
    return ingest.paragraph_mentions(p, x)


@query(TEXT + "SELECT * FROM dmention")
def doc_mentions(spark, d):
    _, p, x = _ingested(spark, d)
    return ingest.document_mentions(p, x)


@query(
    TEXT + """, m AS (SELECT entity_name, p.title FROM pmention m JOIN (SELECT DISTINCT id, title FROM para) p ON p.id = m.source_id UNION SELECT entity_name, source_id FROM dmention)
SELECT e.name, count(DISTINCT m.title) AS doc_count FROM entity e LEFT JOIN m ON m.entity_name = e.name GROUP BY e.name"""
)
def doc_count(spark, d):
    ex, _, x = _ingested(spark, d)
    return ingest.build_graph(ex, x).entities.select("name", "doc_count")


@query(
    TEXT + """SELECT 'documents' AS metric, count(DISTINCT title) AS value FROM para UNION ALL SELECT 'paragraphs', count(DISTINCT id) FROM para UNION ALL SELECT 'entities', count(*) FROM entity
UNION ALL SELECT 'has_paragraph', count(DISTINCT (title, id)) FROM para UNION ALL SELECT 'mentions', (SELECT count(*) FROM pmention) + (SELECT count(*) FROM dmention) UNION ALL SELECT 'relations', count(*) FROM relation"""
)
def graph_stats(spark, d):
    ex, _, x = _ingested(spark, d)
    return ingest.build_graph(ex, x).stats()


@query(ORACLE_SQL["graph_stats"])
def reloaded_graph(spark, d):
    """A graph written over another one in the same place."""
    ex, _, x = _ingested(spark, d)
    path = f"{shared_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    ingest.build_graph(ex.limit(3), x).write(path)
    ingest.build_graph(ex, x).write(path)
    return ingest.Graph.read(spark, path).stats()


@query(TEXT + """, n AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS n FROM (SELECT DISTINCT seq FROM para))
SELECT 'q_' || n.n AS question_id, 'question ' || p.seq AS question, 'answer ' || p.seq AS answer, coalesce(string_agg(p.id, ',' ORDER BY p.pos) FILTER (WHERE p.is_supporting), '') AS supporting_paragraphs FROM para p JOIN n ON n.seq = p.seq GROUP BY n.n, p.seq""")
def ground_truth(spark, d):
    return ingest.ground_truth(X.examples(spark, d)).withColumn("supporting_paragraphs", F.array_join("supporting_paragraphs", ","))


@query(TEXT + "SELECT seq, 'question ' || seq AS question FROM (SELECT DISTINCT seq FROM para ORDER BY seq LIMIT 10)")
def first_examples(spark, d):
    return ingest.first_examples(X.examples(spark, d), 10).select("seq", "question")


@query(
    TEXT + r""", t AS (SELECT name, '**' || array_to_string(list_transform(string_split(name, ''), lambda x, i: CASE WHEN i > 1 AND regexp_matches(string_split(name, '')[i - 1], '\p{L}') THEN lower(x) ELSE upper(x) END), '') || '**: '
  || array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(description, ' | '), lambda x: trim(x)), lambda x: x <> ''))), ' | ') AS x FROM entity WHERE name <> '' AND description <> '')
SELECT name, x AS new_text, sha256(x) AS new_hash FROM t WHERE length(name) % 2 = 0"""
)
def stale_embeddings(spark, d):
    """Names of odd length have their hash stored already, so only the others are pending."""
    _, p, x = _ingested(spark, d)
    e = graph.upsert_entities(ingest.entity_rows(p, x))
    kept = e.withColumn("description_hash", F.when(F.length("name") % 2 == 1, T.sha256(T.embedding_text("name", "description"))).otherwise(F.when(F.length("name") % 4 == 0, "old")))
    return ingest.pending_embeddings(kept).select("name", "new_text", "new_hash")


@query(TEXT + "SELECT title, sha256('model' || chr(10) || title || chr(10) || doc_text) AS cache_key FROM merged WHERE length(title) % 2 = 0")
def cache_misses(spark, d):
    docs = ingest.cache_key(ingest.merged_documents(ingest.explode_paragraphs(X.examples(spark, d))), "model")
    return ingest.cache_misses(docs, docs.where(F.length("title") % 2 == 1)).select("title", "cache_key")


@query(
    """WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN sha256('model' || chr(10) || c_mktsegment) ELSE c_mktsegment END AS key, max(c_custkey) AS value FROM customer GROUP BY 1),
h AS (SELECT *, regexp_matches(key, '^[0-9a-f]{64}$') AS new, CASE WHEN regexp_matches(key, '^[0-9a-f]{64}$') THEN key ELSE sha256('model' || chr(10) || key) END AS k FROM c)
SELECT k AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, key) AS r FROM h) WHERE r = 1"""
)
def cache_key_migration(spark, d):
    c = X.table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, T.sha256(T.joined(F.lit("model"), "c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    return ingest.migrate_cache_keys(c.groupBy(key.alias("key")).agg(F.max("c_custkey").alias("value")), "model")


@query(TEXT + "SELECT seq, count(*) AS n, string_agg(title || ':' || length(text) || ':' || CASE WHEN is_supporting THEN 1 ELSE 0 END, ',' ORDER BY pos) AS shape FROM para WHERE seq % 3 <> 0 GROUP BY seq")
def adapter_paragraphs(spark, d):
    raw = X.examples(spark, d).withColumn("paragraphs", F.transform("paragraphs", lambda p: F.struct(p["title"].alias("title"), p["text"].alias("paragraph_text"), p["is_supporting"].alias("is_supporting"))))
    out = qa.multi_paragraph_examples(raw.withColumn("answerable", F.col("seq") % 3 != 0))
    shape = F.transform("paragraphs", lambda p: F.concat_ws(":", p["title"], F.length(p["text"]), p["is_supporting"].cast("int")))
    return out.select("seq", F.size("paragraphs").cast("bigint").alias("n"), F.array_join(shape, ",").alias("shape"))


_CONTEXT_FORM_SQL = (
    TEXT + r""", s AS (SELECT seq, pos, title, is_supporting, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS t FROM para),
sup AS (SELECT DISTINCT seq, title FROM para WHERE is_supporting), j AS (SELECT s.*, sup.title IS NOT NULL AS good FROM s LEFT JOIN sup ON sup.seq = s.seq AND sup.title = s.title WHERE len(s.t) > 0)
SELECT seq, 'answer ' || seq AS answer, string_agg(title || ':' || length(array_to_string(t, ' ')) || ':' || CASE WHEN good THEN 1 ELSE 0 END, ',' ORDER BY pos) AS shape FROM j GROUP BY seq"""
)


@query(_CONTEXT_FORM_SQL)
def adapter_context(spark, d):
    ex = X.examples(spark, d)
    raw = ex.select(
        "seq", "question", F.array("answer", F.lit("other")).alias("answer"),
        F.struct(F.transform("paragraphs", lambda p: p["title"]).alias("title"), F.transform("paragraphs", lambda p: F.split(p["text"], "\n", -1)).alias("sentences")).alias("context"),
        F.struct(F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: p["title"]).alias("title")).alias("supporting_facts"),
    )
    shape = F.transform("paragraphs", lambda p: F.concat_ws(":", p["title"], F.length(p["text"]), p["is_supporting"].cast("int")))
    return qa.context_examples(raw).select("seq", "answer", F.array_join(shape, ",").alias("shape"))


@query(_CONTEXT_FORM_SQL)
def adapter_context_lists(spark, d):
    """The same with the context as a list of pairs and the supporting facts as a list, a blank title among the former."""
    pair = lambda p: F.struct(p["title"].alias("title"), F.split(p["text"], "\n", -1).alias("sentences"))
    blank = F.array(F.struct(F.lit(" ").alias("title"), F.array(F.lit("x")).alias("sentences")))
    facts = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: F.struct(p["title"].alias("title")))
    raw = X.examples(spark, d).select("seq", "question", "answer", F.concat(F.transform("paragraphs", pair), blank).alias("context"), facts.alias("supporting_facts"))
    shape = F.transform("paragraphs", lambda p: F.concat_ws(":", p["title"], F.length(p["text"]), p["is_supporting"].cast("int")))
    return qa.context_examples(raw).select("seq", "answer", F.array_join(shape, ",").alias("shape"))


@query("SELECT doc_id, lang FROM documents")
def dataset_scan(spark, d):
    return qa.read_dataset(spark, f"{d}/documents.parquet", "doc_id bigint, lang string")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def run_query(spark, d):
    X.table(spark, d, "documents").createOrReplaceTempView("quillgraph_documents")
    return qa.run_query(spark, "SELECT doc_id, n_chars FROM quillgraph_documents WHERE lang = :lang AND n_chars > :least", lang="en", least=500)


@query("SELECT DISTINCT source || '__' || substr(sha256(source || chr(10) || text), 1, 10) AS id, sha256('**' || source || '**: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS new_hash FROM documents WHERE text <> ''")
def stale_paragraphs(spark, d):
    stored = graph.upsert_paragraphs(X.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("title"), "text"))
    return ingest.pending_paragraphs(stored).select("id", "new_hash")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS hash FROM customer")
def embedding_write_back(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("hash"))
    return graph.write_back(c, new, "c_custkey", ["c_mktsegment", "hash"])


@query(TEXT + "SELECT DISTINCT name FROM tnames WHERE length(title) % 2 = 0")
def skipped_extractions(spark, d):
    """Titles of odd length got no extraction at all."""
    _, p, x = _ingested(spark, d)
    none = F.length("title") % 2 == 1
    given = x.withColumns({c: F.when(none, None).otherwise(F.col(c)) for c in ("entities", "triples")})
    return graph.upsert_entities(ingest.entity_rows(p, given)).select("name")


@query(TEXT + "SELECT DISTINCT CASE WHEN length(subject) % 3 = 0 THEN '' ELSE subject END AS src, object AS dst FROM trip")
def blank_endpoints(spark, d):
    """Blank ends of triples are an entity with an empty name."""
    ex, _, x = _ingested(spark, d)
    blank = lambda t: F.struct(F.when(F.length(t["subject"]) % 3 == 0, "").otherwise(t["subject"]).alias("subject"), t["relation"].alias("relation"), t["object"].alias("object"))
    g = ingest.build_graph(ex, x.withColumn("triples", F.transform("triples", blank)))
    return g.relations.join(g.entities.select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst")


# --- resolution

_ENT_SQL = TEXT + ", er AS (SELECT seen * 1000000 + i AS seq, name, type, description FROM ents)"
_DOM_SQL = _ENT_SQL + """, cnt AS (SELECT name, type, count(*) AS n, min(seq) AS f FROM er GROUP BY name, type), dom AS MATERIALIZED (SELECT name, type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS r FROM cnt) WHERE r = 1),
tk AS MATERIALIZED (SELECT name, type, list_distinct(string_split(name, ' ')) AS t FROM dom),
pairs AS MATERIALIZED (SELECT a.name AS a, b.name AS b FROM tk a JOIN tk b ON a.type = b.type AND a.name < b.name WHERE list_has_all(b.t, a.t) OR list_has_all(a.t, b.t))"""


def _entity_list(spark: SparkSession, d: str) -> DataFrame:
    _, p, x = _ingested(spark, d)
    rows = ingest.entity_rows(p, x).where("seq.phase = 0")
    return cut(rows)


@query(_DOM_SQL + " SELECT d.name, d.type, (SELECT array_to_string(list_sort(list_distinct(list(substr(description, 1, 120)))), ';') FROM er WHERE er.name = d.name AND description <> '') AS descriptions FROM dom d")
def dominant_type(spark, d):
    return resolve.dominant_types(_entity_list(spark, d)).withColumn("descriptions", F.array_join("descriptions", ";"))


@query(_DOM_SQL + " SELECT a, b FROM pairs")
def token_subset_pairs(spark, d):
    return resolve.subset_pairs(resolve.dominant_types(_entity_list(spark, d)))


_COMP_SQL = _DOM_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), walk AS (SELECT a AS node, a AS low FROM sym UNION SELECT s.b, w.low FROM walk w JOIN sym s ON s.a = w.node), comp AS MATERIALIZED (SELECT node, min(low) AS cluster FROM walk GROUP BY node)"


@query(_COMP_SQL + " SELECT cluster, string_agg(node, ',' ORDER BY node) AS members FROM comp GROUP BY cluster")
def entity_components(spark, d):
    pairs = resolve.subset_pairs(resolve.dominant_types(_entity_list(spark, d)))
    return resolve.clusters(pairs).withColumn("members", F.array_join("members", ","))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.clusters(resolve.subset_pairs(resolve.dominant_types(_entity_list(spark, d))))
    return cut(found.select(F.get("members", F.lit(0)).alias("canonical_name"), "members", F.concat(F.lit("group of "), F.size("members").cast("string")).alias("description")))


_ALIAS_SQL = _COMP_SQL + ", alias AS MATERIALIZED (SELECT node AS alias, cluster AS canonical, 'group of ' || count(*) OVER (PARTITION BY cluster) AS description FROM comp)"


@query(
    _ALIAS_SQL + """, en AS (SELECT e.title AS extraction, e.i AS pos, coalesce(a.canonical, e.name) AS name, e.type, coalesce(a.description, e.description) AS description FROM ents e LEFT JOIN alias a ON a.alias = e.name)
SELECT extraction, pos, name, type, description FROM (SELECT *, row_number() OVER (PARTITION BY extraction, name ORDER BY pos) AS r FROM en) WHERE r = 1"""
)
def alias_entities(spark, d):
    _, _, x = _ingested(spark, d)
    g = _groups(spark, d)
    e = x.select(F.col("title").alias("extraction"), F.posexplode("entities").alias("pos", "e")).select("extraction", F.col("pos").cast("bigint").alias("pos"), "e.*")
    return resolve.apply_entities(e, resolve.alias_map(g), resolve.canonical_descriptions(g))


@query(_ALIAS_SQL + ", tr AS (SELECT t.title AS extraction, t.i AS pos, coalesce(a.canonical, t.subject) AS subject, t.relation, coalesce(b.canonical, t.object) AS object FROM trip t LEFT JOIN alias a ON a.alias = t.subject LEFT JOIN alias b ON b.alias = t.object) SELECT * FROM tr WHERE subject <> object")
def alias_triples(spark, d):
    _, _, x = _ingested(spark, d)
    t = x.select(F.col("title").alias("extraction"), F.posexplode("triples").alias("pos", "t")).select("extraction", F.col("pos").cast("bigint").alias("pos"), "t.*")
    return resolve.apply_triples(t, resolve.alias_map(_groups(spark, d)))


@query(
    """WITH g AS (SELECT c_nationkey AS k, list(c_name ORDER BY c_custkey) AS members, CASE WHEN c_nationkey % 3 = 0 THEN 'nobody' ELSE min(c_name) END AS canonical_name, CASE WHEN c_nationkey % 5 = 0 THEN '  ' ELSE 'd' END AS description FROM customer WHERE c_custkey < 120 GROUP BY c_nationkey)
SELECT k, canonical_name, len(members) AS n FROM g WHERE len(members) >= 2 AND list_contains(members, canonical_name) AND trim(description) <> ''"""
)
def group_validation(spark, d):
    c = X.table(spark, d, "customer").where("c_custkey < 120")
    k = F.col("c_nationkey")
    g = c.groupBy("c_nationkey").agg(F.collect_list("c_name").alias("members"), F.min("c_name").alias("m"))
    g = g.select(k.alias("k"), "members", F.when(k % 3 == 0, "nobody").otherwise(F.col("m")).alias("canonical_name"), F.when(k % 5 == 0, "  ").otherwise("d").alias("description"))
    return resolve.valid_groups(g).select("k", "canonical_name", F.size("members").cast("bigint").alias("n"))


# --- evaluation

ANS = _with(X.ANSWER_SQL)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score(X.answers(spark, d))


@query(ANS + "SELECT seq, p AS prediction, t AS truth FROM nrm")
def answer_normalize(spark, d):
    return X.answers(spark, d).select("seq", T.normalize_answer("prediction").alias("prediction"), T.normalize_answer("ground_truth").alias("truth"))


@query(ANS + "SELECT seq, em FROM scored")
def exact_match(spark, d):
    return _scored(spark, d).select("seq", "em")


@query(ANS + "SELECT seq, round(f1, 6) AS f1 FROM scored")
def token_f1(spark, d):
    return _scored(spark, d).select("seq", _6("f1"))


@query(ANS + "SELECT seq, CASE WHEN trim(prediction) = '' THEN 0.0 WHEN seq % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS verdict FROM ans")
def verdict(spark, d):
    said = F.when(F.col("seq") % 3 == 0, F.lit(" yes, it is")).otherwise(F.lit("No"))
    return X.answers(spark, d).select("seq", T.verdict("prediction", said).alias("verdict"))


@query(ANS + "SELECT question_id, question, ground_truth, prediction, round(em, 6) AS em, round(f1, 6) AS f1, CAST(NULL AS DOUBLE) AS llm_accuracy, 0::BIGINT AS prompt_tokens, 0::BIGINT AS completion_tokens, 0::BIGINT AS total_tokens, 0.0::DOUBLE AS retrieval_s, 0.0::DOUBLE AS generation_s, 0::BIGINT AS num_paths, 0::BIGINT AS num_entities, 0::BIGINT AS num_seeds, 0::BIGINT AS steps_taken, '' AS seed_entities, '' AS extracted_entities FROM scored")
def eval_rows(spark, d):
    return evaluate.evaluation_rows(_scored(spark, d)).withColumns({"em": F.round("em", 6), "f1": F.round("f1", 6)})


@query(ANS + "SELECT config, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM scored GROUP BY config")
def ablation_summary(spark, d):
    return evaluate.summary(_scored(spark, d)).select("config", "n", _6("em"), _6("f1"))


@query("SELECT event_type AS config, count(value) AS n, round(avg(value), 6) AS mean_s, round(quantile_cont(value, 0.5), 6) AS p50_s, round(quantile_cont(value, 0.95), 6) AS p95_s, round(max(value), 6) AS max_s FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_type").alias("config"), F.col("value").alias("retrieval_s"))
    return evaluate.latency(e).select("config", "n", *map(_6, ("mean_s", "p50_s", "p95_s", "max_s")))


@query("SELECT event_id AS question_id, CASE WHEN event_id % 4 = 0 THEN event_id / 1000.0 ELSE value END AS retrieval_s FROM events")
def latency_patch(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("value").alias("retrieval_s"))
    return evaluate.patch_latency(e, e.where("question_id % 4 = 0").select("question_id", (F.col("question_id") / 1000.0).alias("retrieval_s")))


@query(ANS + "SELECT seq, config, round(avg(em) OVER w, 6) AS em_trailing, round(avg(f1) OVER w, 6) AS f1_trailing FROM scored WINDOW w AS (PARTITION BY config ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_em_f1(spark, d):
    return evaluate.trailing(_scored(spark, d), 100, "config").select("seq", "config", _6("em_trailing"), _6("f1_trailing"))


@query(ANS + ", r AS (SELECT seq, config, row_number() OVER w AS done, avg(em) OVER w AS e, avg(f1) OVER w AS f FROM scored WINDOW w AS (PARTITION BY config ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, config, done, round(e, 6) AS em_running, round(f, 6) AS f1_running FROM r WHERE done % 25 = 0")
def running_em_f1(spark, d):
    return evaluate.running(_scored(spark, d), 25, "config").select("seq", "config", "done", _6("em_running"), _6("f1_running"))


@query(
    STATE3 + "," + PATH_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(resource, 9) DESC, name) AS rank FROM s3)
SELECT q.qid, (SELECT count(*) FROM dedup x WHERE x.qid = q.qid) AS num_paths, (SELECT count(*) FROM r WHERE r.qid = q.qid AND rank <= 30) AS num_entities, (SELECT count(*) FROM s0 WHERE s0.qid = q.qid) AS num_seeds,
  (SELECT string_agg(name, ', ' ORDER BY pos) FROM ask WHERE ask.qid = q.qid) AS extracted_entities FROM q"""
)
def retrieval_counts(spark, d):
    q, a = X.questions(spark, d), X.query_entities(spark, d)
    r = retrieve.retrieve(q, a, X.entities(spark, d), X.relations(spark, d))
    rows = evaluate.evaluation_rows(q.select(F.col("qid").alias("question_id")), r, a)
    return rows.select(F.col("question_id").alias("qid"), "num_paths", "num_entities", "num_seeds", "extracted_entities")


@query(ANS + "SELECT seq, 'Question: ' || question || chr(10) || 'Answer: ' || ground_truth || '.' AS prompt FROM ans")
def prompt_text(spark, d):
    return X.answers(spark, d).select("seq", T.prompt("Question: {q}\nAnswer: {a}.", q=F.col("question"), a=F.col("ground_truth")).alias("prompt"))


@query(ANS + "SELECT question_id, config, prediction, em, round(f1, 6) AS f1 FROM scored")
def csv_round_trip(spark, d):
    """Every configuration's rows written as CSV and read together."""
    rows = evaluate.evaluation_rows(_scored(spark, d).where("config IS NOT NULL")).join(X.answers(spark, d).select("question_id", "config"), "question_id")
    path = f"{shared_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = cut(rows)
    for c in ("0", "1", "2", "3"):
        evaluate.write_csv(rows.where(F.col("config") == c).drop("config"), path, c)
    return evaluate.read_csv(spark, path).select("question_id", "config", F.coalesce("prediction", F.lit("")).alias("prediction"), "em", _6("f1"))


@query("WITH l AS (SELECT event_type AS config, avg(value) AS m FROM events GROUP BY event_type) SELECT row_number() OVER (ORDER BY m, config) AS place, config FROM l")
def ordered_latency(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_type").alias("config"), F.col("value").alias("retrieval_s"))
    numbered = evaluate.latency(e).withColumn("at", F.monotonically_increasing_id())
    return numbered.select(F.row_number().over(Window.orderBy("at")).alias("place"), "config")


@query(ANS + "SELECT seq, CASE WHEN contains(question, 'x') THEN NULL ELSE 're: ' || question END AS prediction, CASE WHEN contains(question, 'x') THEN 'no x please' END AS error, CASE WHEN contains(question, 'x') THEN NULL ELSE 3 END AS total_tokens FROM ans")
def isolated_errors(spark, d):
    """A question that the model fails on is reported; the others are answered."""
    a = X.answers(spark, d).select("seq", "question", F.lit("p").alias("paths_text"), F.lit("d").alias("descriptions_text"))
    return M.answer(a, X.PickyGenerator()).select("seq", "prediction", "error", "total_tokens")


@query(ANS + "SELECT seq, CASE WHEN trim(prediction) = '' THEN 0.0 WHEN lower(trim(prediction)) = lower(trim(ground_truth)) THEN 1.0 ELSE 0.0 END::DOUBLE AS llm_accuracy FROM ans")
def judged_answers(spark, d):
    return M.judged(X.answers(spark, d), M.StubJudge()).select("seq", "llm_accuracy")


@query(
    r"""WITH f AS (SELECT doc_id, regexp_extract_all(substr(text, 1, 200), '[A-Z][a-z]{3,}(?: [a-z]+)?') AS n FROM documents)
SELECT doc_id, len(n) AS n_entities, greatest(len(n) - 1, 0) AS n_triples, coalesce(n[1], '') AS first_name FROM f"""
)
def model_extract(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("doc_text"))
    e = M.extract(docs, M.StubExtractor())
    return e.select("doc_id", F.size("entities").cast("bigint").alias("n_entities"), F.size("triples").cast("bigint").alias("n_triples"), F.coalesce(F.get("entities", F.lit(0))["name"], F.lit("")).alias("first_name"))


@query(r"""WITH f AS (SELECT DISTINCT text AS question, regexp_extract_all(text, '[A-Z][a-z]{3,}') AS n FROM conversations WHERE role = 'user')
SELECT question, unnest(list_transform(n, lambda x: lower(x))) AS name, generate_subscripts(n, 1) - 1 AS pos FROM f""")
def question_entities(spark, d):
    asked = X.table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("question")).distinct()
    found = M.found_entities(asked, M.StubQuestionEntities())
    return M.listed_entities(asked.withColumn("qid", F.col("question")), found).select(F.col("qid").alias("question"), "name", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT DISTINCT text, 64 AS dims FROM conversations")
def cached_embeddings(spark, d):
    """Texts of one role are in the cache, so only the others are embedded; every text has its vector."""
    texts = X.table(spark, d, "conversations").select("role", "text")
    _, cache = M.embed_cached(texts.where("role = 'user'"), spark.createDataFrame([], "key string, embedding array<double>"), M.StubEmbedder(), "stub")
    vectors, _ = M.embed_cached(texts, cache, M.StubEmbedder(), "stub")
    return vectors.select("text", F.size("embedding").alias("dims"))


@query(_COMP_SQL + ", g AS (SELECT cluster, list(node) AS members FROM comp GROUP BY cluster) SELECT (SELECT n FROM (SELECT unnest(members) AS n) ORDER BY length(n) DESC, n DESC LIMIT 1) AS canonical_name, len(members) AS n FROM g")
def resolved_clusters(spark, d):
    found = resolve.clusters(resolve.subset_pairs(resolve.dominant_types(_entity_list(spark, d))))
    return M.resolve_clusters(found, M.StubResolver()).select("canonical_name", F.size("members").cast("bigint").alias("n"))
