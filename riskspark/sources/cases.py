"""The table of cases: upsert, listing, lookup, JSON payloads, model versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.metrics import running


def upsert_cases(existing: DataFrame, updates: DataFrame, key: str = "id", version: str = "seq") -> DataFrame:
    """Union with the highest version per key; one shuffle on the key (Spark keeps one row per key and task before it)."""
    both = existing.unionByName(updates)
    last = Window.partitionBy(key).orderBy(F.desc(version))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def created_key(upload: Column, meta: Column) -> Column:
    """Upload date, else the other date, else nothing."""
    return F.coalesce(F.nullif(F.trim(upload), F.lit("")), F.nullif(F.trim(meta), F.lit("")), F.lit(""))


def list_cases(cases: DataFrame, limit: int = 200) -> DataFrame:
    """Newest first, later rows first on ties; a limit of 0 or less gives none."""
    return cases.orderBy(F.desc("created"), F.desc("seq")).limit(max(0, limit))


def get_case(cases: DataFrame, key: int, column: str = "id") -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return cases.where(F.col(column) == key)


def count_cases(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("n"))


def pack_cases(cases: DataFrame, key: str = "id") -> DataFrame:
    return cases.select(key, F.to_json(F.struct(*cases.columns)).alias("payload"))


def unpack_cases(packed: DataFrame, schema: str) -> DataFrame:
    """Rows of the payloads; a payload that is no JSON object is left out."""
    parsed = packed.select(F.from_json("payload", schema + ", _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("c"))
    return parsed.where("c is not null and c._broken is null").select("c.*").drop("_broken")


def to_lines(df: DataFrame) -> DataFrame:
    """One JSON line per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def examples(features: DataFrame, labels: DataFrame, key: str = "case_id") -> DataFrame:
    """``id, features, label``: every case's features and label as nested objects; a case without a label has a null one."""
    label = F.when(F.col("__labelled"), F.struct(*[c for c in labels.columns if c != key]))
    joined = features.select(F.col(key).alias("id"), F.struct(*[c for c in features.columns if c != key]).alias("features")).join(labels.withColumn("__labelled", F.lit(True)), F.col("id") == F.col(key), "left")
    return joined.select("id", "features", label.alias("label"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; characters beyond ASCII are kept as they are."""
    df.write.mode("overwrite").json(path)


def metrics_document(parts: dict[str, DataFrame]) -> DataFrame:
    """``document``: one JSON object of named parts, each a table of one row."""
    out = None
    for name, df in parts.items():
        one = df.select(F.struct(*df.columns).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*parts)).alias("document"))


def list_versions(versions: DataFrame) -> DataFrame:
    """``model, place, version``: the versions of each model, the one activated last first.

    Places are running counts over ranges, so a model with very many versions is no single task.
    """
    times = versions.groupBy("model", F.struct("activated_at", "version").alias("p")).agg(F.count("*").alias("n"))
    placed = running(times, ("model",), ("n",), down=True)
    return placed.select("model", F.explode(F.sequence((F.col("before_n") + 1).cast("long"), (F.col("before_n") + F.col("n")).cast("long"))).alias("place"), F.col("p.version").alias("version"))


def active_versions(versions: DataFrame) -> DataFrame:
    """Per model: the version activated last, the number of versions and that version's metric."""
    return versions.groupBy("model").agg(F.max_by("version", "activated_at").alias("active"), F.count("*").alias("versions"), F.max_by("metric", "activated_at").cast("long").alias("metric"))


def roll_back(versions: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """Activate older versions again: the rows of ``wanted`` (model, version) with a newer activation; what is not there is not activated."""
    again = versions.join(wanted.select("model", "version").distinct(), ["model", "version"], "left_semi").withColumn("activated_at", at)
    return versions.unionByName(again)
