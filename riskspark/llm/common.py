"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import drop, materialise, shared_folder  # noqa: F401


#: Within ``cut`` an Arrow batch has at most so many rows and bytes; with Spark's default of 10000 whole texts one batch alone takes tens of MB, in the JVM and in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def cut(df: DataFrame) -> DataFrame:
    """``materialise`` with small Arrow batches; the session's own settings are put back."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        conf.set(k, v)
    try:
        return materialise(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has: for helper columns beside a user's own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without copying, and its n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + at)[at:] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Row ranges [a, b) of at most ``most`` bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A 64-bit number for each byte; A-Z count as a-z, white space as nothing.
BYTE = seeded(11, 256) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BYTE[SPACE] = 0
ROOT = np.uint64(0xD6E8FEB86659FD93)


def powers(root: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lowered), and n + 1 row offsets into them."""
    base, end = int(offsets[0]), int(offsets[-1])
    data = data[base:end]
    row = np.asarray(offsets) - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(row), np.int64)
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[row] = True
    fresh = word.copy()
    fresh[1:] &= ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(fresh)
    counts = np.searchsorted(starts, row)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)), axis=0) if starts[0] == 0 else None
    if place is None:
        data, starts = data[starts[0] :], starts - starts[0]
        place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    h = np.add.reduceat(BYTE[data] * powers(ROOT, int(place.max()) + 1)[place], starts)
    return mix(h), counts


#: Bits of a bitmap, as a power of two.
BITS = 27


def inside(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a key may be in the bitmap; never False for one that is."""
    at = keys & np.uint64(32 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, bit = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("block", "bit"))
        for k in np.unique(block):
            words, at = held.setdefault(int(k), np.zeros(size // 32, np.uint32)), bit[block == k]
            np.bitwise_or.at(words, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    for k, words in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([words.tobytes()])], ["block", "bits"])


def bitmap_of(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bitmap of the column ``key``, put together in blocks by the tasks, so that the driver gets 2^bits bits whatever the number of keys."""
    bits = bits or BITS
    size = 1 << max(5, bits - 8)
    at = F.col("key").bitwiseAND((1 << bits) - 1)
    placed = keys.select((at / size).cast("int").alias("block"), (at % size).cast("int").alias("bit")).repartition(64, "block")
    out = np.zeros((1 << bits) // 32, np.uint32)
    for r in placed.mapInArrow(lambda batches: _blocks(batches, size), "block long, bits binary").collect():
        out[r["block"] * size // 32 :][: size // 32] = np.frombuffer(r["bits"], np.uint32)
    return out
