"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash of id and text.
Pass two shuffles each bucket with a seeded Fisher-Yates shuffle.  The buckets one after the other, with
each one's rows in its shuffled order, are a uniform random order of all records; record g of that order is slot
g div n of shard g mod n, so shards differ by one row at most (law ``rows``) and slots have no gaps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.common import cut, documents

BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1: each place from the last one down swaps with a random place up to it."""
    draw = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    for k, j in zip(range(n - 1, 0, -1), draw.integers(0, np.arange(n - 1, 0, -1) + 1).tolist() if n > 1 else [], strict=True):
        order[k], order[j] = order[j], order[k]
    return order


def _shuffle_buckets(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        n, bucket = table.num_rows, parts[0].column("__bucket")[0].as_py()
        order = fisher_yates(n, seed * 1_000_003 + bucket)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # Rows keep their order in memory and carry their place: the reader of a shard sorts by it.
        yield from table.append_column("__place", pa.array(place)).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column("__bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and b > a and held[0].column("__bucket")[0].as_py() != buckets[a]:
                yield from emit(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from emit(held)


def external_shuffle(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` plus ``__shard``, ``__slot``.

    Within a bucket rows are first sorted by their hash, id and text, so the result does not depend on the order in which
    they arrive; rows alike in both are interchangeable.  Null ids and texts are hashed as such.  A long text is one record of its bucket.
    An empty table gives no rows.
    Names that begin with ``__shard``, ``__slot``, ``__bucket``, ``__place``, ``__hash`` or ``__offset`` are taken.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    hashed = docs.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    hashed = hashed.withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(n_buckets)))
    counts = hashed.groupBy("__bucket").agg(F.count("*").alias("n"))
    # Offsets: one row per bucket (total bytes / bucket_bytes of them), summed in runs of 4096 buckets, then over the runs.
    runs = cut(counts.withColumn("run", F.floor(F.col("__bucket") / 4096)))
    before = runs.groupBy("run").agg(F.sum("n").alias("m")).select(F.col("run").alias("r"), (F.sum("m").over(Window.orderBy("run")) - F.col("m")).alias("before"))
    within = Window.partitionBy("run").orderBy("__bucket")
    offsets = cut(runs.join(before, runs["run"] == before["r"]).select(F.col("__bucket").alias("__at"), (F.col("before") + F.sum("n").over(within) - F.col("n")).alias("__offset")))
    scattered = hashed.repartition("__bucket").sortWithinPartitions("__bucket", "__hash", id_col)
    schema = T.StructType([*scattered.schema.fields, T.StructField("__place", T.LongType())])
    shuffled = scattered.mapInArrow(lambda batches: _shuffle_buckets(batches, seed), schema)
    if n_buckets <= 100_000:  # below 3 MB; beyond that, a join by shuffle
        offsets = F.broadcast(offsets)
    position = F.col("__offset") + F.col("__place")
    placed = shuffled.join(offsets, shuffled["__bucket"] == offsets["__at"])
    return placed.withColumn("__shard", F.pmod(position, F.lit(n_shards)).cast("int")).withColumn("__slot", F.floor(position / n_shards).cast("long")).drop("__hash", "__bucket", "__place", "__at", "__offset")


def write_shards(docs: DataFrame, folder: str, n_shards: int = 8, **how) -> None:
    """Write the shuffled records, one folder per shard, each file sorted by slot."""
    shuffled = external_shuffle(docs, n_shards, **how)
    files = F.floor(F.col("__slot") / 100_000)
    shuffled.repartition("__shard", files).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(folder)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return external_shuffle(docs, 8).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
