"""Connection graphs: the neighbours of a case, and edges between cases that share something."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.session import drop, materialise


def top_handles(links: DataFrame, most: int = config.HANDLES_MOST) -> DataFrame:
    """``case_id, n, label``: the first handles of a case, with an at-sign."""
    rows = links.where("kind = 'telegram'").groupBy("case_id", F.lower("value").alias("low")).agg(F.min(F.struct("place", "kind_ord", "at", "value")).alias("o"))
    n = Window.partitionBy("case_id").orderBy("o")
    return rows.withColumn("n", F.row_number().over(n)).where(F.col("n") <= most).select("case_id", "n", F.concat(F.lit("@"), F.regexp_replace("o.value", "^@", "")).alias("label"))


def top_tags(tags: DataFrame, most: int = config.TAGS_MOST) -> DataFrame:
    """``case_id, n, label``: tags by frequency (case aside), then first seen."""
    rows = tags.select("case_id", F.posexplode("tags").alias("pos", "tag")).groupBy("case_id", F.lower("tag").alias("low")).agg(F.count("*").alias("c"), F.min(F.struct("pos", "tag")).alias("o"))
    n = Window.partitionBy("case_id").orderBy(F.desc("c"), "o")
    return rows.withColumn("n", F.row_number().over(n)).where(F.col("n") <= most).select("case_id", "n", F.col("o.tag").alias("label"))


def related(kb: DataFrame, rows: DataFrame, most: int = config.RELATED_MOST) -> DataFrame:
    """Related items of a case's cluster (``rows``: cluster, n, label, type), by an equi-join."""
    return kb.join(rows.where(F.col("n") <= most), "cluster").select("case_id", "n", "label", "type")


def neighbours(handles: DataFrame, tags: DataFrame, near: DataFrame) -> DataFrame:
    """``case_id, id, type, label``: union of neighbours, each type and label once, numbered n1.. in order."""
    parts = [handles.select("case_id", F.lit(0).alias("g"), "n", F.lit("telegram").alias("type"), "label"), tags.select("case_id", F.lit(1).alias("g"), "n", F.lit("hashtag").alias("type"), "label"), near.select("case_id", F.lit(2).alias("g"), "n", "type", "label")]
    once = reduce(DataFrame.unionByName, parts).groupBy("case_id", "type", F.lower("label").alias("low")).agg(F.min(F.struct("g", "n", "label")).alias("o"))
    k = Window.partitionBy("case_id").orderBy("o.g", "o.n", "type")
    return once.withColumn("k", F.row_number().over(k)).select("case_id", "k", F.concat(F.lit("n"), "k").alias("id"), "type", F.col("o.label").alias("label"))


def edges(nodes: DataFrame) -> DataFrame:
    """``case_id, id, source, target, type``: one edge from the case (node v1) to each neighbour; its kind goes by the neighbour's type."""
    kind = F.when(F.col("type") == "telegram", "contact").when(F.col("type") == "hashtag", "hashtag").otherwise("similar")
    return nodes.select("case_id", F.concat(F.lit("e"), "k").alias("id"), F.lit("v1").alias("source"), F.col("id").alias("target"), kind.alias("type"))


def with_center(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``case_id, id, type, label``: the neighbours, and the case itself as node v1 (``labels``: case_id, label)."""
    own = labels.select("case_id", F.lit("v1").alias("id"), F.lit("video").alias("type"), "label")
    return own.unionByName(nodes.select("case_id", "id", "type", "label"))


def ring(nodes: DataFrame) -> DataFrame:
    """Coordinates on a ring around the case, with a wobble of the radius by number mod 3."""
    count = F.count("*").over(Window.partitionBy("case_id"))
    angle = 2 * F.pi() * (F.col("k") - 1) / count
    radius = 35 + 4 * ((F.col("k") - 1) % 3)
    return nodes.select("case_id", "id", F.round(50 + radius * F.cos(angle), 4).alias("x"), F.round(50 + radius * F.sin(angle), 4).alias("y"))


def shared_edges(entities: DataFrame) -> DataFrame:
    """``a, b``: each case linked to the smallest case that shares an entity (handle or tag).

    A star per entity instead of all pairs: the components are the same, and an entity that a third of all cases share gives one edge per case.
    """
    least = materialise(entities.groupBy("entity").agg(F.min("case_id").alias("a")))
    return entities.join(least, "entity").where("case_id > a").select("a", F.col("case_id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``case_id, cluster``: smallest case reachable. Labels are lowered along edges, then through labels, until nothing changes; each round is written."""
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(both.groupBy(F.col("a").alias("case_id")).agg(F.least(F.min("b"), F.col("a")).alias("cluster")))
    while True:
        near = both.join(labels, both["b"] == labels["case_id"]).groupBy("a").agg(F.min("cluster").alias("near"))
        step = materialise(labels.join(near, labels["case_id"] == near["a"]).select("case_id", F.least("cluster", "near").alias("cluster"), F.col("cluster").alias("old")))
        jump = step.select(F.col("case_id").alias("c"), F.col("cluster").alias("next"))
        after = materialise(step.join(jump, step["cluster"] == jump["c"]).select("case_id", F.least("cluster", "next").alias("cluster"), "old"))
        drop(labels, step)
        if after.where("cluster <> old").isEmpty():
            drop(both)
            return after.select("case_id", "cluster")
        labels = after
