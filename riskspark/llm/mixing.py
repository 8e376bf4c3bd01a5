"""Mixing sources to target weights by dependent rounding (the pivotal method).

A source's target over its size says how often each of its documents is to be taken, a
fraction between 0 and 3.  Whole copies are certain; the fractional part is rounded so that a
source's taken words stay within one document of its target.  Two documents that are still
undecided hold ``mass`` = fraction * size words each.  Words move from one to the other, by a
draw that keeps both expectations, until one of the two is taken wholly or not at all; the
other goes on as the residual.  Blocks of documents are folded this way, then the blocks'
residuals, and so on: a reduction tree whose depth is the logarithm of the largest source.

DataFrame and SQL functions only.  No group holds more than a few hundred rows, however large a source is.
Draws are hashes of the two ids and the seed, so reruns and retried tasks agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import cut, documents, unused

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows ``source, size``.

    Sources by code point, null last, take ``weights`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight until
    none is above.  Filled in closed form: sources are capped in order of cap / weight, as long as a cap is
    under the share that the sources left would get.  The windows run over one row per source, not per document.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    cap = F.lit(most) * F.col("source_size")
    everything = Window.partitionBy()
    rising = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all_size") - F.coalesce(F.sum(cap).over(rising), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    filled = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("first_free", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything))
    )
    target = F.least(cap, F.coalesce(F.col("first_free.level"), F.lit(0.0)) * F.col("weight"))
    return filled.select("source", F.col("source_size").cast("long").alias("source_size"), "n_docs", target.cast("double").alias("target"))


def _fold(units: Column, seed: int, id_type: str) -> Column:
    """Fold an array of undecided units (first, key, id, each, size, mass) to {left: the residual, done: [(id, each, taken)]}.

    Units come largest first, so what is left at the end, and with it the error, is a small document.  ``key`` is a hash for order and draws
    only; a unit is told by its source, ``id`` and ``each`` (the size of one of its rows), so clashing hashes do no harm.
    """

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        up, down = F.least(a["size"] - a["mass"], b["mass"]), F.least(a["mass"], b["size"] - b["mass"])
        draw = F.pmod(F.xxhash64(F.lit(seed), a["key"], b["key"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
        rise = draw * (up + down) < down
        a_mass = F.when(rise, F.when(a["size"] - a["mass"] <= b["mass"], a["size"]).otherwise(a["mass"] + up)).otherwise(F.when(a["mass"] <= b["size"] - b["mass"], F.lit(0.0)).otherwise(a["mass"] - down))
        b_mass = F.when(rise, F.when(b["mass"] <= a["size"] - a["mass"], F.lit(0.0)).otherwise(b["mass"] - up)).otherwise(F.when(b["size"] - b["mass"] <= a["mass"], b["size"]).otherwise(b["mass"] + down))
        a_done = (a_mass <= 0.0) | (a_mass >= a["size"])
        unit = lambda u, mass: F.struct(*(u[c].alias(c) for c in ("first", "key", "id", "each", "size")), mass.alias("mass"))
        decision = lambda u, mass: F.struct(u["id"].alias("id"), u["each"].alias("each"), (mass > 0.0).alias("up"))
        return F.struct(
            F.when(a_done, unit(b, b_mass)).otherwise(unit(a, a_mass)).alias("left"),
            F.concat(state["done"], F.array(F.when(a_done, decision(a, a_mass)).otherwise(decision(b, b_mass)))).alias("done"),
        )

    nothing = F.array().cast(f"array<struct<id:{id_type},each:bigint,up:boolean>>")
    return F.aggregate(F.slice(units, 2, F.size(units)), F.struct(units[0].alias("left"), nothing.alias("done")), step)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    Null and empty texts have size 0 and are taken as often as their source's whole copies say (0 words).
    Rows that repeat an id (or have none) within a source with the same size share one draw: they are rounded as one unit, so ties are
    only broken between units, by hash.  A null source is a source of its own, apart from every text; ids are compared as they are.
    A long text counts all its words.  An empty table gives no rows.  Only the three named columns are read, so other columns may have any name.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sizes, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select("doc_id", sizes["source"], "size", "source_size", "n_docs", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("part"))
    # Rows that agree in source, id and size are interchangeable: one unit.
    live = rows.where((F.col("part") > 0) & (F.col("size") > 0)).groupBy("source", "doc_id", F.col("size").alias("each")).agg(F.sum("size").cast("double").alias("size"), F.first("part").alias("part"), F.first("n_docs").alias("n_docs"))
    live = live.withColumn("key", F.xxhash64(F.lit(seed), "source", "doc_id", "each"))
    blocks = F.ceil(F.col("n_docs") / block).cast("long")
    live = live.select(F.col("source"), F.pmod(F.xxhash64(F.lit(seed + 1), "key"), blocks).alias("block"), F.struct((-F.col("size")).alias("first"), "key", F.col("doc_id").alias("id"), "each", "size", (F.col("size") * F.col("part")).alias("mass")).alias("unit"))
    most_blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 0
    decided, id_type = [], sizes.schema["doc_id"].dataType.simpleString()
    while True:
        level = cut(live.groupBy("source", "block").agg(_fold(F.array_sort(F.collect_list("unit")), seed, id_type).alias("f")))
        decided.append(level.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.each", "d.up"))
        if most_blocks <= 1:
            last = F.pmod(F.xxhash64(F.lit(seed + 2), "f.left.key"), F.lit(1 << 52)) / F.lit(float(1 << 52))
            decided.append(level.select("source", "f.left.id", "f.left.each", (last * F.col("f.left.size") < F.col("f.left.mass")).alias("up")))
            break
        live = level.select("source", F.floor(F.col("block") / block).alias("block"), F.col("f.left").alias("unit"))
        most_blocks = -(-most_blocks // block)
    up = reduce(DataFrame.unionByName, decided)
    copies = F.col("whole") + F.when(F.col("up"), 1).otherwise(0)
    same = rows["source"].eqNullSafe(up["source"]) & rows["doc_id"].eqNullSafe(up["id"]) & (rows["size"] == up["each"])
    return rows.join(up, same, "left").select("doc_id", rows["source"], "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Rows that repeat an id with the same source and size repeat one decision.  Empty documents and null texts hold no words, so they are taken 0 times; an empty
    table stays empty.  Columns may have any name: those that are added take names that ``docs`` does not use.
    """
    names = {c: unused(docs, f"__mix_{c}") for c in ("doc_id", "source", "size", "copies")}
    mixed = mix_sources(docs, id_col, text_col, source_col, **how).where("taken > 0").select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    words, copy = unused(docs, "__mix_words"), unused(docs, "__mix_copy")
    sized = docs.withColumn(words, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"))
    same = sized[id_col].eqNullSafe(mixed[names["doc_id"]]) & sized[source_col].eqNullSafe(mixed[names["source"]]) & (sized[words] == mixed[names["size"]])
    joined = sized.join(mixed, same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), names["copies"]))).select(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
