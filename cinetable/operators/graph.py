"""Entities and relations as two tables (S21, J11, G12), and evidence found through them (U-4, R17, W6).

Nodes are names; an entity's sources are chunk ids joined by ``SEP``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinetable.operators.retrieval import dense_top
from cinetable.plans.columns import col

SEP = "<SEP>"


def merged_entities(mentions: DataFrame) -> DataFrame:
    """One row an entity (G12): name, kind, description, source_id, mentions.

    ``mentions``: name, kind, description, source_id. Names are equal regardless of case and outer space; ``kind`` is
    the most frequent one (ties: the first in order); different descriptions and sources are joined in order by ``SEP``.
    Null names are left out. Kinds, descriptions and sources are made distinct before they are gathered, so
    what is gathered is what the row holds."""
    named = mentions.withColumn("name", F.upper(F.trim("name"))).where("name is not null and name <> ''")
    parts = [named.groupBy("name").agg(F.count("*").alias("mentions"))]
    kinds = named.where("kind is not null").groupBy("name", "kind").agg(F.count("*").alias("n"))
    parts.append(kinds.groupBy("name").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind")))
    for part in ("description", "source_id"):
        distinct = named.where(col(part).isNotNull()).select("name", part).distinct()
        parts.append(distinct.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(part)), SEP).alias(part)))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, "name", "left")
    return joined.select("name", "kind", "description", "source_id", "mentions")


def merged_relations(relations: DataFrame) -> DataFrame:
    """One row an undirected relation (G12): a, b (a < b), weight (their sum, 1 where null), relations. Loops and null ends are left out."""
    real = relations.where("a is not null and b is not null and a <> b")
    pair = real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return pair.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.count("*").alias("relations"))


def _ends(relations: DataFrame) -> DataFrame:
    """name and other of both directions."""
    return relations.select(F.explode(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))).alias("_e")).select("_e.*")


def node_degrees(relations: DataFrame) -> DataFrame:
    """name and degree of every node of merged relations."""
    return _ends(relations).groupBy("name").agg(F.count("*").alias("degree"))


def edge_degrees(relations: DataFrame) -> DataFrame:
    """The relations and the sum of their ends' degrees."""
    degrees = node_degrees(relations)
    for end in ("a", "b"):
        relations = relations.join(degrees.select(F.col("name").alias(end), F.col("degree").alias(f"_{end}")), end)
    return relations.withColumn("degree", F.col("_a") + F.col("_b")).drop("_a", "_b")


def one_hop(names: DataFrame, relations: DataFrame) -> DataFrame:
    """name and neighbour of the asked names."""
    return names.select("name").distinct().join(_ends(relations), "name").select("name", F.col("other").alias("neighbour"))


def sources_of(entities: DataFrame) -> DataFrame:
    """name and chunk_id of every source of the entities."""
    ids = F.explode(F.split("source_id", SEP))
    return entities.select("name", ids.alias("chunk_id")).where("chunk_id <> ''").distinct()


def chunks_by_relations(names: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, chunk_id and how many neighbours of the name have the chunk as a source as well, for its own chunks."""
    own = sources_of(entities)
    asked = own.join(names.select("name").distinct(), "name", "left_semi")
    beside = one_hop(names, relations).join(own.withColumnRenamed("name", "neighbour"), "neighbour").groupBy("name", "chunk_id").agg(F.count("*").alias("shared"))
    return asked.join(beside, ["name", "chunk_id"], "left").select("name", "chunk_id", F.coalesce("shared", F.lit(0)).alias("relations"))


def either(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments that one or the other search found, once, in order (U-4)."""
    return first.select(*keys).unionByName(second.select(*keys)).distinct().orderBy(*keys)


def similar_above(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, **names: str) -> DataFrame:
    """``dense_top`` without what is below a threshold."""
    return dense_top(vectors, queries, k, **names).where(F.col("score") >= threshold)


def evidence_csv(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """keys and evidence: each group's rows as CSV with a header, in order (R17). A group is what one question found."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *map(quoted, columns))
    numbered = rows.select(*(col(k) for k in keys), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_n"), line.alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"])
    return numbered.groupBy(*keys).agg(F.concat_ws("\n", F.lit(",".join(columns)), F.array_join(lines, "\n")).alias("evidence"))


def within_budget(items: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """The first items of each group whose sizes add up to at most ``budget`` (W6); null sizes count as 0.

    The first item that doesn't fit ends the list. Groups are what one question found."""
    window = Window.partitionBy(*(col(k) for k in keys)).orderBy(*(col(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.greatest(F.coalesce(col(size), F.lit(0)), F.lit(0))).over(window)
    return items.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")
