"""The property graph as tables: set-based upserts, counts and the adjacency.

Every upsert takes rows with an explicit seq column, the order in which single statements would have run; results do not
depend on partitioning. Writing the result over the old table is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions import text as T


def first_by(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The first row of every key, key nulls left out."""
    rest = [c for c in df.columns if c not in (key, seq)]
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest) if rest else F.lit(0), seq).alias("__r"))
    return out.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*(c for c in df.columns if c != seq))


def ordered(value: Column, seq: str = "seq") -> Column:
    """Aggregate: the values that are not null, by seq. The first of repeated values is enough for append-only folds."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(seq).alias("s"), value.alias("v"))))), lambda x: x["v"])


def upsert_documents(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("title").where("title IS NOT NULL").distinct()


def upsert_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(id, text, doc_title) from rows (seq, title, text); the first of each id."""
    rows = paragraphs.select("seq", T.paragraph_id("title", "text").alias("id"), "text", F.col("title").alias("doc_title"))
    return first_by(rows, "id")


def has_paragraph(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select("title", T.paragraph_id("title", "text").alias("paragraph_id")).where("paragraph_id IS NOT NULL").distinct()


def upsert_entities(rows: DataFrame) -> DataFrame:
    """(name, type, description) from rows (seq, name, type, description).

    The type is that of the first row, also where null; descriptions grow by append_distinct in the order of seq. Repeated
    descriptions of a name are dropped before they are collected, as they never change the text.
    """
    types = rows.where("name IS NOT NULL").groupBy("name").agg(F.min_by("type", "seq").alias("type"))
    once = rows.where("name IS NOT NULL AND description IS NOT NULL").groupBy("name", "description").agg(F.min("seq").alias("seq"))
    texts = once.groupBy("name").agg(T.fold_descriptions(ordered(F.col("description"))).alias("description"))
    return types.join(texts, "name", "left")


def upsert_relations(rows: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(src, dst, relation) from rows (seq, src, dst, relation): one edge per ordered pair, its relations folded.

    With entities, edges without both ends are skipped.
    """
    pairs = rows.where("src IS NOT NULL AND dst IS NOT NULL")
    if entities is not None:
        names = entities.select("name")
        pairs = pairs.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    once = pairs.groupBy("src", "dst", "relation").agg(F.min("seq").alias("seq"))
    return once.groupBy("src", "dst").agg(T.fold_descriptions(ordered(F.col("relation"))).alias("relation"))


def upsert_mentions(rows: DataFrame, entities: DataFrame, documents: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """Distinct (source_kind, source_id, entity_name) whose entity exists, and whose document or paragraph does where those tables are given."""
    out = rows.select("source_kind", "source_id", "entity_name").distinct().join(entities.select(F.col("name").alias("entity_name")), "entity_name", "left_semi")
    if documents is not None and paragraphs is not None:
        known = documents.select(F.lit("document").alias("source_kind"), F.col("title").alias("source_id")).union(paragraphs.select(F.lit("paragraph"), F.col("id")))
        out = out.join(known, ["source_kind", "source_id"], "left_semi")
    return out.select("source_kind", "source_id", "entity_name")


def doc_counts(entities: DataFrame, mentions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(name, doc_count): documents that mention an entity, themselves or through a paragraph."""
    by_paragraph = mentions.where("source_kind = 'paragraph'").join(paragraphs.select(F.col("id").alias("source_id"), F.col("doc_title").alias("title")), "source_id").select("entity_name", "title")
    by_document = mentions.where("source_kind = 'document'").select("entity_name", F.col("source_id").alias("title"))
    counts = by_paragraph.union(by_document).where("title IS NOT NULL").groupBy(F.col("entity_name").alias("name")).agg(F.countDistinct("title").alias("doc_count"))
    return entities.select("name").join(counts, "name", "left").select("name", F.coalesce("doc_count", F.lit(0)).cast("bigint").alias("doc_count"))


def graph_stats(**tables: DataFrame) -> DataFrame:
    """(metric, value): the number of rows of every table given."""
    parts = [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjacency(relations: DataFrame) -> DataFrame:
    """(src, dst, relation, forward): every edge from both ends; reciprocal edges stay two, loops go."""
    proper = relations.where("src <> dst").select("src", "dst", "relation")
    return proper.withColumn("forward", F.lit(True)).union(proper.select(F.col("dst"), F.col("src"), "relation", F.lit(False)))


def stale(rows: DataFrame, stored: str, text: Column) -> DataFrame:
    """Rows whose stored hash is not that of text, with the new text and hash as new_text and new_hash."""
    out = rows.withColumn("new_text", text).withColumn("new_hash", T.sha256("new_text"))
    return out.where(~F.col(stored).eqNullSafe(F.col("new_hash")))


def write_back(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns replaced where updates has the key."""
    new = updates.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit"))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)).alias(c) if c in columns else F.col(c) for c in dict.fromkeys([*rows.columns, *columns])))
