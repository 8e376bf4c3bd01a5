"""The nested document of a case, as a caller gets it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``case_id, name``: the rows of a case as an array of structs, by ``order``."""
    fields = [c for c in rows.columns if c != "case_id"]
    struct = F.struct(*order, F.struct(*fields).alias("__row"))
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["__row"]).alias(name))


def case_documents(posts: DataFrame, cases: DataFrame, dims: DataFrame, timeline: DataFrame, cards: list[DataFrame], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per case: title, score, level, category, reason, and arrays of dimensions, timeline, evidence, nodes and edges.

    Each part is bounded per case (eight dimensions, eight events, six cards, fifteen nodes) and grouped by case on its own, then joined.
    """
    number = F.when(F.col("id") == "v1", 0).otherwise(F.substring("id", 2, 9).cast("int"))  # n2 before n10, the case itself first
    parts = [
        listed(dims.select("case_id", "dim_no", "dim", "value"), "dna", "dim_no"),
        listed(timeline.withColumn("n", F.substring("id", 2, 9).cast("int")), "timeline", "n"),
        listed(reduce(DataFrame.unionByName, cards), "evidence", "type"),
        listed(nodes.withColumn("n", number), "nodes", "n", "id"),
        listed(edges.withColumn("n", number), "edges", "n", "id"),
    ]
    head = cases.select("case_id", "score", "level", "category", "reason").join(posts.select("case_id", F.coalesce("title", F.lit("")).alias("title"), "created"), "case_id")
    joined = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, head)
    names = ("dna", "timeline", "evidence", "nodes", "edges")
    return joined.select("case_id", "title", F.date_format("created", "yyyy-MM-dd").alias("upload_date"), "score", "level", "category", "reason", *[F.coalesce(n, F.array().cast(joined.schema[n].dataType)).alias(n) for n in names])
