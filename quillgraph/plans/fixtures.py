"""The graph and the question sets that the queries use, derived from the synthetic tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TYPES = ("PERSON", "PLACE", "WORK", "EVENT", "THING")
NAME_PATTERN = "[A-Z][a-z]{3,}(?: [a-z]+)?"
EXTRACT_CHARS = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    text = F.concat(F.lit("entity "), F.col("vec_id").cast("string"), F.lit(" of group "), F.col("label").cast("string"))
    return e.select(_named("e", F.col("vec_id")).alias("name"), _named("t", F.col("label")).alias("type"), text.alias("description"), F.col("embedding").cast("array<double>").alias("description_embedding"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") < 3 * n)
    ends = o.select(_named("e", F.col("o_custkey") % n).alias("src"), _named("e", (F.col("o_orderkey") * 7 + 1) % n).alias("dst"), "o_orderpriority")
    return ends.groupBy("src", "dst").agg(F.min("o_orderpriority").alias("relation"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 7")
    return e.select(_named("q", F.col("vec_id")).alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))


def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two per question: known names, unknown ones with a hint, or both."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("hint_embedding"))
    asked = e.where("vec_id % 100 = 7").select("vec_id", F.floor(F.col("vec_id") / 100).alias("g"))
    first = asked.select("vec_id", F.lit(0).alias("pos"), F.when(F.col("g") % 2 == 0, _named("e", F.col("vec_id"))).otherwise(_named("unknown", F.col("vec_id"))).alias("name"), F.col("vec_id").alias("hint"))
    second = asked.where("g % 3 <> 2").select("vec_id", F.lit(1).alias("pos"), F.when(F.col("g") % 3 == 0, _named("e", F.col("vec_id") + 3)).otherwise(_named("missing", F.col("vec_id"))).alias("name"), (F.col("vec_id") + 3).alias("hint"))
    both = first.unionByName(second)
    hints = e.withColumnRenamed("vec_id", "hint")
    return both.join(hints, "hint", "left").select(_named("q", F.col("vec_id")).alias("qid"), "pos", "name", "hint_embedding")


GRAPH_SQL = """
ent AS MATERIALIZED (SELECT 'e' || vec_id AS name, 't' || label AS type, 'entity ' || vec_id || ' of group ' || label AS description, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
entn AS MATERIALIZED (SELECT *, sqrt(list_dot_product(v, v)) AS nrm FROM ent),
rel AS MATERIALIZED (
  SELECT src, dst, min(o_orderpriority) AS relation FROM (
    SELECT 'e' || (o_custkey % n) AS src, 'e' || ((o_orderkey * 7 + 1) % n) AS dst, o_orderpriority FROM orders, (SELECT count(*) AS n FROM embeddings) WHERE o_orderkey < 3 * n) GROUP BY src, dst),
adj AS MATERIALIZED (SELECT src, dst, relation, true AS forward FROM rel WHERE src <> dst UNION ALL SELECT dst, src, relation, false FROM rel WHERE src <> dst),
q AS MATERIALIZED (SELECT 'q' || vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm FROM embeddings WHERE vec_id % 100 = 7),
ask0 AS (
  SELECT vec_id, 0 AS pos, CASE WHEN (vec_id // 100) % 2 = 0 THEN 'e' || vec_id ELSE 'unknown' || vec_id END AS name, vec_id AS hint FROM embeddings WHERE vec_id % 100 = 7
  UNION ALL
  SELECT vec_id, 1, CASE WHEN (vec_id // 100) % 3 = 0 THEN 'e' || (vec_id + 3) ELSE 'missing' || vec_id END, vec_id + 3 FROM embeddings WHERE vec_id % 100 = 7 AND (vec_id // 100) % 3 <> 2),
ask AS MATERIALIZED (SELECT 'q' || a.vec_id AS qid, a.pos, a.name, CAST(h.embedding AS DOUBLE[]) AS v FROM ask0 a LEFT JOIN embeddings h ON h.vec_id = a.hint)
"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents to an example; a document's title is its source, its paragraph its text, supporting where it is labelled good."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    p = d.join(good, "doc_id", "left").select(
        F.floor(F.col("doc_id") / 4).alias("seq"), F.struct("doc_id", F.col("source").alias("title"), "text", (F.coalesce("quality", F.lit(0)) == 1).alias("is_supporting")).alias("p")
    )
    paragraphs = F.transform(F.array_sort(F.collect_list("p")), lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text"), x["is_supporting"].alias("is_supporting")))
    return p.groupBy("seq").agg(paragraphs.alias("paragraphs")).select("seq", _named("question ", F.col("seq")).alias("question"), _named("answer ", F.col("seq")).alias("answer"), "paragraphs")


def extractions(documents: DataFrame) -> DataFrame:
    """A stand-in for a model: capitalised words of merged documents (title, doc_text), typed by length, neighbours linked."""
    names = F.regexp_extract_all(F.substring("doc_text", 1, EXTRACT_CHARS), F.lit(NAME_PATTERN), 0)
    kinds = F.array(*map(F.lit, TYPES))
    entity = lambda n: F.struct(n.alias("name"), F.element_at(kinds, F.length(n) % 5 + 1).alias("type"), F.concat(n, F.lit(" in "), F.col("title")).alias("description"))
    rows = documents.withColumn("names", names)
    triple = lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("subject"), F.concat(F.lit("Near "), F.substring(b, 1, 2)).alias("relation"), b.alias("object")))
    pairs = F.filter(F.zip_with("names", F.slice("names", F.lit(2), F.size("names")), triple), lambda t: t.isNotNull())
    return rows.select("title", F.transform("names", entity).alias("entities"), pairs.alias("triples"))


TEXT_SQL = f"""
para AS MATERIALIZED (SELECT d.doc_id // 4 AS seq, d.doc_id % 4 AS pos, d.source AS title, d.text, coalesce(l.quality, 0) = 1 AS is_supporting, d.source || '__' || substr(sha256(d.source || chr(10) || d.text), 1, 10) AS id
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
once AS (SELECT title, text, min(seq * 4 + pos) AS seen FROM para GROUP BY title, text),
merged AS MATERIALIZED (SELECT title, '**' || title || '**' || chr(10) || string_agg(text, chr(10) ORDER BY seen) AS doc_text FROM once GROUP BY title),
found AS MATERIALIZED (SELECT title, regexp_extract_all(substr(doc_text, 1, {EXTRACT_CHARS}), '{NAME_PATTERN}') AS names FROM merged),
firstat AS (SELECT title, min(seq * 4 + pos) AS seen FROM para GROUP BY title),
raw_ent AS (SELECT title, unnest(names) AS raw, generate_subscripts(names, 1) - 1 AS i FROM found),
ents AS MATERIALIZED (SELECT r.title, f.seen, r.i, lower(r.raw) AS name, ['PERSON', 'PLACE', 'WORK', 'EVENT', 'THING'][length(r.raw) % 5 + 1] AS type, r.raw || ' in ' || r.title AS description FROM raw_ent r JOIN firstat f ON f.title = r.title),
trip AS MATERIALIZED (SELECT a.title, f.seen, a.i, lower(a.raw) AS subject, lower('Near ' || substr(b.raw, 1, 2)) AS relation, lower(b.raw) AS object FROM raw_ent a JOIN raw_ent b ON b.title = a.title AND b.i = a.i + 1 JOIN firstat f ON f.title = a.title),
erows AS MATERIALIZED (
  SELECT (seen * 2) * 1000000 + i * 2 AS seq, name, type, description FROM ents
  UNION ALL SELECT (seen * 2 + 1) * 1000000 + i * 2, subject, NULL, NULL FROM trip
  UNION ALL SELECT (seen * 2 + 1) * 1000000 + i * 2 + 1, object, NULL, NULL FROM trip),
entity AS MATERIALIZED (SELECT name, arg_min_null(type, seq) AS type,
  list_reduce(list(description ORDER BY seq) FILTER (WHERE description IS NOT NULL), lambda x, y: CASE WHEN contains(x, y) THEN x ELSE x || ' | ' || y END) AS description FROM erows GROUP BY name),
relation AS MATERIALIZED (SELECT subject AS src, object AS dst,
  list_reduce(list(relation ORDER BY seen * 1000000 + i), lambda x, y: CASE WHEN contains(x, y) THEN x ELSE x || ' | ' || y END) AS relation FROM trip GROUP BY subject, object),
tnames AS MATERIALIZED (SELECT DISTINCT title, name FROM ents UNION SELECT title, subject FROM trip UNION SELECT title, object FROM trip),
pmention AS MATERIALIZED (SELECT DISTINCT 'paragraph' AS source_kind, p.id AS source_id, t.name AS entity_name FROM para p JOIN tnames t ON t.title = p.title WHERE contains(lower(p.text), lower(t.name))),
dmention AS MATERIALIZED (SELECT DISTINCT 'document' AS source_kind, o.title AS source_id, o.name AS entity_name FROM
  (SELECT DISTINCT p.seq, p.title, e.name FROM para p JOIN (SELECT DISTINCT title, name FROM ents) e ON e.title = p.title) o
  WHERE NOT EXISTS (SELECT 1 FROM para p WHERE p.seq = o.seq AND p.title = o.title AND contains(lower(p.text), lower(o.name))))
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs from conversations: a user's turn and the assistant's next, against the assistant's answer without its first word."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])
    predicted = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("The "), F.col("truth"))).when(F.col("conv_id") % 5 == 1, F.lit("")).otherwise(F.regexp_replace("truth", r"^\S+\s*", ""))
    seq = F.col("conv_id") * 1000 + F.col("turn")
    return pairs.select(seq.alias("seq"), F.concat(F.lit("c"), seq.cast("string")).alias("question_id"), "question", predicted.alias("prediction"), F.col("truth").alias("ground_truth"), (F.col("conv_id") % 4).cast("string").alias("config"))


_NORMAL = "trim(regexp_replace(list_aggregate(list_filter(string_split_regex(translate(lower(coalesce({0}, '')), '{1}', ''), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the')), 'string_agg', ' '), ' +', ' ', 'g'))"
PUNCT_SQL = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def normal_sql(c: str) -> str:
    return "coalesce(" + _NORMAL.replace("{0}", c).replace("{1}", PUNCT_SQL) + ", '')"


ANSWER_SQL = f"""
pairs AS (SELECT u.conv_id * 1000 + u.turn AS seq, u.conv_id, u.text AS question, a.text AS truth FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
ans AS MATERIALIZED (SELECT seq, 'c' || seq AS question_id, question, truth AS ground_truth, CAST(conv_id % 4 AS VARCHAR) AS config,
  CASE WHEN conv_id % 5 = 0 THEN 'The ' || truth WHEN conv_id % 5 = 1 THEN '' ELSE regexp_replace(truth, '^\\S+\\s*', '') END AS prediction FROM pairs),
nrm AS MATERIALIZED (SELECT *, {normal_sql('prediction')} AS p, {normal_sql('ground_truth')} AS t FROM ans),
tok AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS pt, list_filter(string_split(t, ' '), lambda w: w <> '') AS tt FROM nrm),
com AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(pt, tt)), lambda w: least(len(list_filter(pt, lambda x: x = w)), len(list_filter(tt, lambda x: x = w))))), 0) AS c FROM tok),
scored AS MATERIALIZED (SELECT seq, question_id, question, ground_truth, config, prediction, CASE WHEN p = t THEN 1.0 ELSE 0.0 END::DOUBLE AS em,
  CASE WHEN len(pt) = 0 OR len(tt) = 0 THEN CASE WHEN len(pt) = len(tt) THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0
       ELSE 2 * (c / len(pt)) * (c / len(tt)) / (c / len(pt) + c / len(tt)) END::DOUBLE AS f1 FROM com)
"""


class PickyGenerator:
    """A stand-in that fails on every question that holds an x, and echoes the others."""

    def generate(self, question: str, paths: str, descriptions: str) -> dict:
        if "x" in question:
            raise ValueError("no x please")
        return {"prediction": f"re: {question}", "prompt_tokens": 2, "completion_tokens": 1}
