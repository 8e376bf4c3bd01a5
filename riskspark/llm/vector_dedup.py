"""Near-duplicate vectors by Euclidean p-stable hashing, confirmed by exact cosines.

1. Classes: equal vectors under one label are one vertex with a count, so exact copies cost nothing later on.
2. Tables: a vector of length 1 is projected on ``k`` Gaussian directions per table, and floor((a.v + b) / WIDTH) for all of them is its bucket there.  Two vectors
   of a link are at most sqrt(2 - 2 * least) apart, so the chance of one equal quantum, of all ``k``, and of a common bucket in at least one of the tables follow from
   the p-stable law; ``k`` is such that a vector meets a quarter of an unrelated one per table, the number of tables such that a pair exactly
   at the threshold is missed with probability MISS (closer pairs by much less).  Both grow with the logarithm of the largest label's number of vectors.
3. Stars: in its buckets each vector looks at the smallest vertex whose 64-bit sign sketch is near its own, one pair each; exact cosines
   confirm, and the links so found are closed to components.
4. Rest: in buckets that still hold several components, members with a near sketch in another component are compared exactly, in tiles of BLOCK;
   of two components that meet there one link is enough.  Then components are closed again.
5. Counts: links lie within components, so each component is compared with itself once, in tiles of BLOCK that give a number per vector and no pairs.
   A component of g different vectors takes g^2 / 2 products, spread over tasks; small ones share a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import bitmap_of, cut, drop, inside, mix, seeded
from riskspark.llm.near_dedup import components, stars_of

#: Width of a quantum in units of the threshold's distance, and the chance to miss a pair exactly at the threshold.
WIDTH, MISS = 8.0, 0.005
#: Sketches that differ in more of their 64 bits are not looked at; at 0.98 the chance for that is under 1e-9.
FAR = 20
#: Vectors that are compared with each other at once, and rows of a task that compares several small groups.
BLOCK, TASK = 2048, 8192
SEED = 97


def same_quantum(ratio: float) -> float:
    """Chance that two points whose distance is 1 / ``ratio`` of a quantum's width fall into the same one (the p-stable law for p = 2)."""
    return 1 - math.erfc(ratio / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan(size: int, least: float) -> tuple[int, int, float]:
    """Projections per table, number of tables and width of a quantum for ``size`` vectors of a label."""
    near = math.sqrt(2 - 2 * least)
    width = WIDTH * near
    k = max(6, math.ceil(math.log(4 * max(2, size)) / -math.log(same_quantum(width / math.sqrt(2)))))
    tables = math.ceil(math.log(MISS) / math.log(1 - same_quantum(WIDTH) ** k))
    return k, tables, width


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of length 1, by number of dimensions."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(1, keepdims=True))


def _index(batches: Iterable[pa.RecordBatch], k: int, tables: int, width: float, shared=None) -> Iterator[pa.RecordBatch]:
    """key, vertex, sketch: a row per vector and table; with a bitmap those whose key may be in it only."""
    made = {}
    times = seeded(SEED, k) | np.uint64(1)
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            vertex, label = part.column("vertex").to_numpy(), part.column("label").to_numpy().astype(np.uint64)
            for rows, x in matrices(part.column("vector")):
                d = x.shape[1]
                if d not in made:
                    rng = np.random.default_rng([SEED, d])
                    made[d] = rng.standard_normal((d, tables * k)), rng.random(tables * k) * width, rng.standard_normal((d, 64))
                directions, shift, signs = made[d]
                quanta = np.floor((x @ directions + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
                salt = mix(label[rows][:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64) + np.uint64(d << 32))
                keys = mix((quanta * times).sum(2, dtype=np.uint64) ^ salt).ravel()
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64).ravel()
                of, own = np.repeat(vertex[rows], tables), np.repeat(sketch, tables)
                if shared is not None:
                    ok = inside(shared.value, keys)
                    keys, of, own = keys[ok], of[ok], own[ok]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(of), pa.array(own)], ["key", "vertex", "sketch"])


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether cosines of unit vectors reach ``least``; those within rounding of it are summed exactly."""
    c = x @ y.T
    out = c >= least
    for i, j in zip(*np.nonzero(np.abs(c - least) < 1e-13), strict=True):
        out[i, j] = math.fsum(x[i] * y[j]) / math.sqrt(math.fsum(x[i] * x[i]) * math.fsum(y[j] * y[j])) >= least
    return out


def _confirm(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for (rows, x), (_, y) in zip(matrices(batch.column("a")), matrices(batch.column("b")), strict=True):
            c = (x * y).sum(1)
            near = c >= least
            for i in np.flatnonzero(np.abs(c - least) < 1e-13):
                near[i] = linked(x[i : i + 1], y[i : i + 1], least)[0, 0]
            ok[rows] = near
        yield batch.select(["lo", "hi"]).filter(pa.array(ok))


def confirm(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (lo, hi) whose cosine reaches ``least``."""
    a, b = (classes.select(F.col("vertex").alias(n), F.col("vector").alias(v)) for n, v in (("lo", "a"), ("hi", "b")))
    joined = pairs.join(a, "lo").join(b, "hi").where(F.size("a") == F.size("b"))
    return cut(joined.select("lo", "hi", "a", "b").mapInArrow(lambda batches: _confirm(batches, least), "lo long, hi long"))


def tiled(rows: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Rows with ``task, part, side``: a group within BLOCK shares a task with others; a larger one is cut into blocks, and each pair of blocks is a task.

    ``side``: 2 where rows of a part are compared among themselves, else 0 against 1.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vertex"), F.col("__blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda j: F.struct(F.least(F.col("__own"), j).alias("i"), F.greatest(F.col("__own"), j).alias("j"), F.when(F.col("__own") == j, 2).when(F.col("__own") < j, 0).otherwise(1).alias("side")))
    placed = rows.withColumn("__blocks", blocks).withColumn("__own", own).withColumn("__t", F.explode(tiles))
    shared = F.pmod(F.xxhash64(group), F.lit(max(1, total // TASK))).cast("string")
    task = F.when(F.col("__blocks") == 1, shared).otherwise(F.concat_ws(":", F.col(group), "__t.i", "__t.j"))
    return placed.select(*rows.columns, task.alias("task"), F.col("__t.side").alias("side"))


def _sides(table: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers to compare with each other, group by group: the same ones twice, or those of two blocks."""
    key, side = table.column(group).to_numpy(), table.column("side").to_numpy()
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
        if (side[rows] == 2).all():
            yield rows, rows
        else:
            yield rows[side[rows] == 0], rows[side[rows] == 1]


def _apart(table: pa.Table) -> pa.Table:
    """Members (key, vertex) of buckets with a near sketch in another component."""
    sketch, component = table.column("sketch").to_numpy().astype(np.uint64), table.column("component").to_numpy()
    keep = np.zeros(len(sketch), bool)
    for left, right in _sides(table, "key"):
        for a in range(0, len(left), 256):
            rows = left[a : a + 256]
            near = (np.bitwise_count(sketch[rows][:, None] ^ sketch[right]) <= FAR) & (component[rows][:, None] != component[right])
            keep[rows[near.any(1)]] = True
            keep[right[near.any(0)]] = True
    return table.select(["key", "vertex"]).filter(pa.array(keep))


def _vectors(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of dimensions per row, and its unit vector."""
    out: list = [None] * table.num_rows
    for rows, x in matrices(table.column("vector")):
        for r, v in zip(rows, x, strict=True):
            out[r] = v
    return np.array([len(v) for v in out]), out


def _join(table: pa.Table, least: float) -> pa.Table:
    """A link (lo, hi) for each two components with one, within the buckets of a task."""
    vertex, component = table.column("vertex").to_numpy(), table.column("component").to_numpy()
    sizes, unit = _vectors(table)
    found = {}
    for left, right in _sides(table, "key"):
        for d in np.unique(sizes[left]):
            i, j = left[sizes[left] == d], right[sizes[right] == d]
            if not len(j):
                continue
            y = np.stack([unit[r] for r in j])
            for a in range(0, len(i), 256):
                rows = i[a : a + 256]
                near = linked(np.stack([unit[r] for r in rows]), y, least) & (component[rows][:, None] != component[j])
                for p, q in zip(*np.nonzero(near), strict=True):
                    u, v = rows[p], j[q]
                    found.setdefault((min(component[u], component[v]), max(component[u], component[v])), (min(vertex[u], vertex[v]), max(vertex[u], vertex[v])))
    lo, hi = ([p[k] for p in found.values()] for k in (0, 1))
    return pa.table({"lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _count(table: pa.Table, least: float) -> pa.Table:
    """vertex, links: how many rows of other vectors of its component (of a tile) each vector is linked with."""
    many, (sizes, unit) = table.column("many").to_numpy(), _vectors(table)
    links = np.zeros(table.num_rows, np.int64)
    for left, right in _sides(table, "component"):
        for d in np.unique(sizes[left]):
            i, j = left[sizes[left] == d], right[sizes[right] == d]
            if not len(j):
                continue
            y = np.stack([unit[r] for r in j])
            for a in range(0, len(i), 512):
                rows = i[a : a + 512]
                near = linked(np.stack([unit[r] for r in rows]), y, least)
                if left is right:
                    near[np.arange(len(rows)), a + np.arange(len(rows))] = False
                    links[rows] += near @ many[j]
                else:
                    links[rows] += near @ many[j]
                    links[j] += near.T @ many[rows]
    return pa.table({"vertex": table.column("vertex"), "links": pa.array(links)})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """One row per input row: ``vec_id, n_links`` (other rows whose label is equal and whose cosine is at least ``least``), ``component_id`` (the smallest id reachable).

    A null label or vector, a vector with a null or non-finite entry and one of zeros only link with nothing; nor do vectors of different lengths.  Every row is a
    vector of its own: a repeated row is linked with its like, and a null id is counted as a neighbour but is never the smallest.  Rows in no component have
    their own id.  Ties do not matter.  An empty table gives no rows.  Only the three named columns are read, so others may have any name.
    """
    spark = vectors.sparkSession
    e = F.col("vector")
    good = F.col("label").isNotNull() & F.coalesce(F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0), F.lit(False))
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.xxhash64(label_col).alias("label"), F.col(label_col).isNull().alias("__none"))
    rows = named.withColumn("label", F.when(~F.col("__none"), F.col("label"))).drop("__none")
    digest = [F.when(good, F.xxhash64(F.lit(seed), "label", "vector")).alias(f"d{seed}") for seed in (1, 2)]
    signed = rows.select("vec_id", *digest)
    once = rows.where(good).select("vec_id", "label", "vector", *digest).groupBy("d1", "d2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # A vertex is numbered by the written table, so that the number is unique whatever the ids.
    classes = cut(cut(once).withColumn("vertex", F.monotonically_increasing_id()))
    size = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, tables, width = plan(size, least)

    narrow = classes.select("vertex", "label", "vector")
    index = "key long, vertex long, sketch long"
    met = narrow.mapInArrow(lambda batches: _index(batches, k, tables, width), index).groupBy("key").agg(F.min(F.struct("vertex", "sketch")).alias("first"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(vertex))").alias("set"), F.sum(F.pmod(F.xxhash64(F.lit(3), "vertex"), F.lit(1 << 40)).cast("decimal(38,0)")).alias("total"))
    # Of buckets with the same members one is enough.
    buckets = cut(met.where("n > 1").groupBy("first", "n", "set", "total").agg(F.min("key").alias("key")).select("key", "n", F.col("first.vertex").alias("least"), F.col("first.sketch").alias("near")))
    shared = spark.sparkContext.broadcast(bitmap_of(buckets.select("key"), min(28, max(16, (32 * buckets.count()).bit_length()))))  # 2^28 bits at most
    members = cut(narrow.mapInArrow(lambda batches: _index(batches, k, tables, width, shared), index).join(buckets, "key"))
    shared.destroy()
    drop(buckets)

    stars = members.where((F.col("vertex") > F.col("least")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("near"))) <= FAR)).groupBy(F.col("vertex").alias("hi")).agg(F.min("least").alias("lo"))
    links = confirm(stars.select("lo", "hi"), classes, least)
    labels = components(links)
    labelled = members.join(labels, "vertex", "left").select("key", "n", "vertex", "sketch", F.coalesce("component", "vertex").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = cut(labelled.join(mixed, "key"))
    drop(members, links)
    total = rest.count()
    near = cut(tiled(rest, "key", "n", total).groupBy("task").applyInArrow(_apart, "key long, vertex long").distinct())
    again = near.join(rest.select("key", "n", "vertex", "component"), ["key", "vertex"]).join(classes.select("vertex", "vector"), "vertex")
    more = cut(tiled(again, "key", "n", total).groupBy("task").applyInArrow(lambda t: _join(t, least), "lo long, hi long").distinct())
    closed = components(stars_of(labels).unionByName(more))
    drop(rest, near, labels, more)

    sizes = closed.groupBy("component").agg(F.count("*").alias("n"))
    joined = closed.join(sizes, "component").join(classes.select("vertex", "vector", "many"), "vertex")
    counted = tiled(joined, "component", "n", closed.count()).groupBy("task").applyInArrow(lambda t: _count(t, least), "vertex long, links long").groupBy("vertex").agg(F.sum("links").alias("links"))
    smallest = closed.join(classes.select("vertex", "least"), "vertex").groupBy("component").agg(F.min("least").alias("component_id"))
    placed = closed.join(smallest, "component").join(counted, "vertex").select("vertex", "component_id", "links")
    of_class = cut(classes.join(placed, "vertex", "left").select("d1", "d2", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    drop(closed, classes)
    return signed.join(of_class, ["d1", "d2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
