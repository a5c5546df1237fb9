"""From question-answering examples with paragraphs to the graph's tables.

Examples are rows (seq, question, answer, paragraphs array<struct<title,text,is_supporting>>); extractions are rows (title, entities
array<struct<name,type,description>>, triples array<struct<subject,relation,object>>), one per title, null arrays where a model gave nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.storage import cut


def explode_paragraphs(examples: DataFrame) -> DataFrame:
    """(seq, pos, title, text, is_supporting)."""
    return examples.select("seq", F.posexplode("paragraphs").alias("pos", "p")).select("seq", "pos", "p.title", "p.text", "p.is_supporting")


def first_examples(examples: DataFrame, n: int | None) -> DataFrame:
    """The first n examples by seq; all where n is 0 or None."""
    return examples.orderBy("seq").limit(n) if n else examples


def distinct_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(title, text, id) of the distinct paragraphs."""
    return paragraphs.select("title", "text").distinct().withColumn("id", T.paragraph_id("title", "text"))


def merged_documents(paragraphs: DataFrame) -> DataFrame:
    """(title, doc_text): the distinct texts of a title in the order of first sight, under the title in bold."""
    once = paragraphs.groupBy("title", "text").agg(F.min(F.struct("seq", "pos")).alias("at"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return once.groupBy("title").agg(texts.alias("t")).select("title", F.concat(F.lit("**"), F.col("title"), F.lit("**\n"), F.array_join("t", "\n")).alias("doc_text"))


def cache_key(documents: DataFrame, model: str) -> DataFrame:
    return documents.withColumn("cache_key", T.sha256(T.joined(F.lit(model), "title", "doc_text")))


def cache_misses(keyed: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return keyed.join(cache.select(key), key, "left_anti")


def normalize_extractions(extractions: DataFrame) -> DataFrame:
    """Names, types and relations in normal form; entities with a blank name go, triples stay as they are."""
    entities = F.transform("entities", lambda e: F.struct(T.normalize_name(e["name"]).alias("name"), T.normalize_type(e["type"]).alias("type"), T.strip(e["description"]).alias("description")))
    triples = F.transform("triples", lambda t: F.struct(T.normalize_name(t["subject"]).alias("subject"), T.normalize_relation(t["relation"]).alias("relation"), T.normalize_name(t["object"]).alias("object")))
    return extractions.withColumns({"entities": F.filter(entities, lambda e: e["name"] != ""), "triples": triples})


def migrate_cache_keys(cache: DataFrame, model: str) -> DataFrame:
    """(key, value) with keys that are plain texts replaced by hashes of model and text; an entry that has the hash already wins."""
    hashed = cache.withColumn("new", T.is_hash("key")).withColumn("to", F.when(F.col("new"), F.col("key")).otherwise(T.sha256(T.joined(F.lit(model), "key"))))
    rank = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("new"), F.asc("key")))
    return hashed.withColumn("r", rank).where("r = 1").select(F.col("to").alias("key"), "value")


def _occurrences(paragraphs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each title's extraction at its first paragraph: applying it again never changes anything."""
    at = paragraphs.groupBy("title").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return at.join(extractions.where("entities IS NOT NULL OR triples IS NOT NULL"), "title")


def entity_rows(paragraphs: DataFrame, extractions: DataFrame) -> DataFrame:
    """(seq, name, type, description) in upsert order: entities, then both ends of every triple, which have neither type nor description."""
    o = _occurrences(paragraphs, extractions)
    seq = lambda phase, i, end: F.struct("at", F.lit(phase).alias("phase"), i.alias("i"), F.lit(end).alias("end"))
    named = o.select("at", F.posexplode("entities").alias("i", "e")).select(seq(0, F.col("i"), 0).alias("seq"), "e.name", "e.type", "e.description")
    none = F.lit(None).cast("string")
    parts = [o.select("at", F.posexplode("triples").alias("i", "t")).select(seq(1, F.col("i"), end).alias("seq"), F.col(f"t.{side}").alias("name"), none.alias("type"), none.alias("description")) for end, side in enumerate(("subject", "object"))]
    return named.unionByName(parts[0]).unionByName(parts[1])


def relation_rows(paragraphs: DataFrame, extractions: DataFrame) -> DataFrame:
    return _occurrences(paragraphs, extractions).select("at", F.posexplode("triples").alias("i", "t")).select(F.struct("at", "i").alias("seq"), F.col("t.subject").alias("src"), F.col("t.object").alias("dst"), "t.relation")


def _names(extractions: DataFrame, triples: bool) -> DataFrame:
    named = extractions.select("title", F.explode("entities.name").alias("name"))
    if not triples:
        return named.distinct()
    ends = extractions.select("title", F.explode(F.concat("triples.subject", "triples.object")).alias("name"))
    return named.union(ends).distinct()


def paragraph_mentions(paragraphs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Mentions (source_kind, source_id, entity_name) of entities and triple ends whose name occurs in a paragraph of their title."""
    held = distinct_paragraphs(paragraphs).join(_names(extractions, True), "title").where(T.mentions("text", "name"))
    return held.select(F.lit("paragraph").alias("source_kind"), F.col("id").alias("source_id"), F.col("name").alias("entity_name")).distinct()


def document_mentions(paragraphs: DataFrame, extractions: DataFrame) -> DataFrame:
    """Mentions by a document of its entities that, in some example, none of that example's paragraphs of the title mentions."""
    own = paragraphs.select("seq", "title").distinct().join(_names(extractions, False), "title")
    matched = paragraphs.select("seq", "title", "text").distinct().join(_names(extractions, False), "title").where(T.mentions("text", "name")).select("seq", "title", "name")
    left = own.join(matched, ["seq", "title", "name"], "left_anti")
    return left.select(F.lit("document").alias("source_kind"), F.col("title").alias("source_id"), F.col("name").alias("entity_name")).distinct()


def ground_truth(examples: DataFrame) -> DataFrame:
    """(question_id, question, answer, supporting_paragraphs); ids count from q_0 by seq, supporting paragraphs keep order and repeats."""
    ids = F.transform(F.filter("paragraphs", lambda p: p["is_supporting"]), lambda p: T.paragraph_id(p["title"], p["text"]))
    # Numbering is global: it sorts the examples' keys alone, not their texts.
    numbered = examples.select("seq", (F.row_number().over(Window.orderBy("seq")) - 1).alias("n"))
    return examples.join(numbered, "seq").select(F.concat(F.lit("q_"), F.col("n").cast("string")).alias("question_id"), "question", "answer", ids.alias("supporting_paragraphs"))


@dataclass(frozen=True)
class Graph:
    documents: DataFrame
    paragraphs: DataFrame
    entities: DataFrame
    has_paragraph: DataFrame
    mentions: DataFrame
    relations: DataFrame

    def stats(self) -> DataFrame:
        return G.graph_stats(documents=self.documents, paragraphs=self.paragraphs, entities=self.entities, has_paragraph=self.has_paragraph, mentions=self.mentions, relations=self.relations)

    def write(self, path: str) -> None:
        """Every table as Parquet under path, replacing what is there."""
        for name, df in vars(self).items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    @staticmethod
    def read(spark, path: str) -> Graph:
        return Graph(**{name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in Graph.__dataclass_fields__})


def build_graph(examples: DataFrame, extractions: DataFrame, skip_blank: bool = False) -> Graph:
    """All tables of the graph, doc_count included. Blank triple ends become an entity "" that every text mentions, unless skip_blank."""
    paragraphs = explode_paragraphs(examples)
    ex = normalize_extractions(extractions)
    if skip_blank:
        ex = ex.withColumn("triples", F.filter("triples", lambda t: (t["subject"] != "") & (t["object"] != "")))
    rows = paragraphs.select(F.struct("seq", "pos").alias("seq"), "title", "text")
    # Entities and mentions each go into several tables of the graph, and their making is the costly part.
    named = cut(G.upsert_entities(entity_rows(paragraphs, ex)))
    stored, titles = G.upsert_paragraphs(rows), G.upsert_documents(rows)
    mentions = cut(G.upsert_mentions(paragraph_mentions(paragraphs, ex).unionByName(document_mentions(paragraphs, ex)), named, titles, stored))
    counted = named.join(G.doc_counts(named, mentions, stored), "name")
    return Graph(titles, stored, counted, G.has_paragraph(rows), mentions, G.upsert_relations(relation_rows(paragraphs, ex), named))


def pending_embeddings(entities: DataFrame) -> DataFrame:
    """Entities with a name and a description whose stored description_hash is missing or old, with new_text and new_hash."""
    rows = entities if "description_hash" in entities.columns else entities.withColumn("description_hash", F.lit(None).cast("string"))
    return G.stale(rows.where("name <> '' AND description <> ''"), "description_hash", T.embedding_text("name", "description"))


def pending_paragraphs(paragraphs: DataFrame) -> DataFrame:
    rows = paragraphs if "text_hash" in paragraphs.columns else paragraphs.withColumn("text_hash", F.lit(None).cast("string"))
    return G.stale(rows.where("id <> '' AND text <> ''"), "text_hash", T.canonical_paragraph("doc_title", "text"))
