"""Entity resolution: dominant types, candidate clusters by token subsets, alias groups and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillgraph.functions import text as T
from quillgraph.operators.components import connected_components


def dominant_types(entities: DataFrame) -> DataFrame:
    """(name, type, descriptions) from rows (seq, name, type, description): the most frequent type, the one seen first of several, and the
    sorted distinct first 120 characters of descriptions.
    """
    counted = entities.groupBy("name", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), F.asc("first")))).where("r = 1")
    short = entities.groupBy("name").agg(F.sort_array(F.collect_set(F.when(F.col("description") != "", F.substring("description", 1, 120)))).alias("descriptions"))
    return best.select("name", "type").join(short, "name")


def subset_pairs(named: DataFrame) -> DataFrame:
    """(a, b), a < b: names of one type of which one's token set holds the other's. Names without tokens pair with nothing.

    An inverted index finds the pairs: each name is looked up by the rarest of its tokens within the type, which every name that holds it has too.
    """
    rows = named.select("name", "type", F.array_distinct(T.tokens(T.collapse("name"))).alias("tokens"))
    words = rows.select("name", "type", "tokens", F.explode("tokens").alias("token"))
    frequency = words.groupBy("type", "token").agg(F.count("*").alias("n"))
    ranked = words.join(frequency, ["type", "token"])
    rarest = ranked.groupBy("name", "type").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("short"))
    pairs = rarest.withColumnRenamed("name", "x").join(words.withColumnRenamed("name", "y"), ["type", "token"])
    held = pairs.where((F.col("x") != F.col("y")) & (F.size("short") <= F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0))
    return held.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster, members): connected names, two or more, named by the smallest."""
    found = connected_components(pairs, "a", "b")
    return found.groupBy(F.col("component").alias("cluster")).agg(F.sort_array(F.collect_set("node")).alias("members")).where(F.size("members") >= 2)


def valid_groups(groups: DataFrame) -> DataFrame:
    """Groups (canonical_name, members, description) of two or more members that name one of them and have a description."""
    return groups.where((F.size("members") >= 2) & F.array_contains("members", F.col("canonical_name")) & (T.strip("description") != ""))


def alias_map(groups: DataFrame) -> DataFrame:
    """(alias, canonical, description), names in normal form; of several canonical names of an alias the smallest."""
    canonical = T.normalize_name("canonical_name")
    each = groups.select(F.explode("members").alias("m"), canonical.alias("canonical"), "description").select(T.normalize_name("m").alias("alias"), "canonical", "description")
    return each.where("alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical"), F.min_by("description", "canonical").alias("description"))


def canonical_descriptions(groups: DataFrame) -> DataFrame:
    return groups.groupBy(T.normalize_name("canonical_name").alias("name")).agg(F.min("description").alias("description"))


def apply_entities(entities: DataFrame, aliases: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Entities (extraction, pos, name, type, description) under their canonical names: the first of a name in an extraction stays, with the group's description."""
    m = aliases.select(F.col("alias").alias("name"), "canonical")
    renamed = entities.join(m, "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")
    first = renamed.withColumn("r", F.row_number().over(Window.partitionBy("extraction", "name").orderBy("pos"))).where("r = 1").drop("r")
    own = descriptions.select("name", F.col("description").alias("__d"))
    return first.join(own, "name", "left").withColumn("description", F.coalesce("__d", "description")).select("extraction", "pos", "name", "type", "description")


def apply_triples(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples (extraction, pos, subject, relation, object) under canonical names, without those from a name to itself; repeats stay."""
    out = triples
    for side in ("subject", "object"):
        m = aliases.select(F.col("alias").alias(side), F.col("canonical").alias(f"__{side}"))
        out = out.join(m, side, "left").withColumn(side, F.coalesce(f"__{side}", side)).drop(f"__{side}")
    return out.where(~F.col("subject").eqNullSafe(F.col("object"))).select("extraction", "pos", "subject", "relation", "object")
