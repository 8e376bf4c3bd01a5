"""Exact duplicates by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 32 bytes hits a pattern, so equal
texts are cut alike and long texts become short recipes: ordered lists of chunk identifiers.

1. Chunks: every chunk gets a 128-bit digest.  Chunk contents move once, deduplicated on the map side, to be
   verified: contents are grouped by their bytes, and a digest that stands for more than one content is
   replaced, in the affected recipes, by digest and ordinal.  After that an identifier means one content.
2. Recipes: texts are equal exactly when their identifier lists are.  Only ids and recipes move here,
   a few hundredths of the text, and groups are pre-aggregated before the shuffle, so a text that holds a
   third of all rows reaches a reducer as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.llm.common import cut, documents, seeded, slices, text_buffer, unused

#: Bounds of a chunk in bytes; the pattern makes about one cut in 4096 bytes after the lower bound.
LEAST, MOST, PATTERN = 1024, 16384, np.uint32(0xFFF00000)
#: Bytes of a chunk's digest; identifiers are verified whatever the size.
DIGEST_BYTES = 16
GEAR = (seeded(5, 256) >> np.uint64(32)).astype(np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row (positions in ``data``); an empty row has none.

    The hash is a sum over the last 32 bytes, each shifted by its age, so it can be doubled up for all
    positions at once; no cut is looked for in the first LEAST bytes, so a row's cuts depend on that row only.
    """
    base = int(offsets[0])
    h = GEAR[data[base : int(offsets[-1])]]
    for k in (1, 2, 4, 8, 16):
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    hits = np.flatnonzero((h & PATTERN) == 0) + base + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while b - a > LEAST:
            k = int(np.searchsorted(hits, a + LEAST))
            e = min(int(hits[k]) if k < len(hits) else b, a + MOST, b)
            if e == b:
                break
            ends.append(e)
            a = e
        if b > a:
            ends.append(b)
        out.append(ends)
    return out


def _cut_batch(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[int]]]]:
    data, offsets = text_buffer(batch.column("text"))
    for a, b in slices(offsets, most):
        part = offsets[a : b + 1]
        yield a, b, data, part, cuts(data, part)


def _digest(x: memoryview, size: int) -> bytes:
    return hashlib.blake2b(x, digest_size=size).digest()


def _contents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """digest, content of every chunk, once per slice."""
    for batch in batches:
        for _, _, data, part, ends in _cut_batch(batch):
            view, seen = memoryview(data), {}
            for a, row in zip(part[:-1].tolist(), ends, strict=True):
                for e in row:
                    piece = view[a:e]
                    seen.setdefault((_digest(piece, size), bytes(piece)))
                    a = e
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.binary())], ["digest", "content"])


def _recipes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """doc_id, sha256 and the recipe (the digests in order) of every row."""
    for batch in batches:
        recipes, shas = [], []
        for _, _, data, part, ends in _cut_batch(batch):
            view = memoryview(data)
            for a, b, row in zip(part[:-1].tolist(), part[1:].tolist(), ends, strict=True):
                shas.append(hashlib.sha256(view[a:b]).hexdigest())
                recipe = []
                for e in row:
                    recipe.append(_digest(view[a:e], size))
                    a = e
                recipes.append(b"".join(recipe))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["doc_id", "sha", "recipe"])


def _clashes(texts: DataFrame, size: int) -> DataFrame:
    """digest, content, ordinal of the chunks whose digest stands for several contents (none, as a rule)."""
    contents = texts.mapInArrow(lambda batches: _contents(batches, size), "digest binary, content binary").distinct()
    several = cut(contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    if several.isEmpty():
        return several.select("digest", F.lit(None).cast("binary").alias("content"), F.lit(0).alias("ordinal"))
    return cut(contents.join(several, "digest").withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("content"))))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``doc_id, sha, recipe`` per row, with verified identifiers in the recipe."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = cut(texts.mapInArrow(lambda batches: _recipes(batches, digest_bytes), "doc_id long, sha string, recipe binary"))
    clashes = _clashes(texts, digest_bytes)
    if clashes.isEmpty():
        return plain
    # A digest with two contents: the rows that use it carry the ordinals of those chunks behind the recipe.
    # Chunks are cut again for those rows only, and are told apart by their bytes.
    pieces = texts.mapInArrow(lambda batches: _pieces(batches, digest_bytes), "doc_id long, sha string, place int, digest binary, content binary")
    ordinals = pieces.join(clashes, ["digest", "content"]).distinct().groupBy("doc_id", "sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal"))), lambda x: F.concat_ws(":", x["place"], x["ordinal"])), ",").cast("binary").alias("more"))
    joined = plain.join(ordinals, plain["doc_id"].eqNullSafe(ordinals["doc_id"]) & (plain["sha"] == ordinals["sha"]), "left")
    return cut(joined.select(plain["doc_id"], plain["sha"], F.concat(plain["recipe"], F.coalesce("more", F.lit(b""))).alias("recipe")))


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, _, data, part, ends in _cut_batch(batch):
            view, rows = memoryview(data), []
            for k, (a, b, row) in enumerate(zip(part[:-1].tolist(), part[1:].tolist(), ends, strict=True)):
                sha = hashlib.sha256(view[a:b]).hexdigest()
                for place, e in enumerate(row):
                    rows.append((ids[first + k], sha, place, _digest(view[a:e], size), bytes(view[a:e])))
                    a = e
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "sha", "place", "digest", "content"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, repeats`` (rows alike in id and text).

    Of equal texts (a null counts as empty) the row with the largest id stays; null ids come first in that order, so a
    group without any id has a null ``keep_id`` and keeps one row.  If that id is repeated with the same text, one of the
    rows, which are then alike, is kept.  An empty table gives no rows.  Only the two named columns are read.
    """
    rows = recipes(docs, id_col, text_col, digest_bytes)
    distinct = rows.groupBy("doc_id", "sha", "recipe").agg(F.count("*").alias("repeats"))
    groups = cut(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    joined = distinct.join(groups, "recipe")
    # Repeated rows come back one by one; only the first of them can be the one that stays.
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"), "repeats")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of rows alike in id and text one.

    Texts are moved once, by a join with the ids and digests of the rows that stay, which is a filter and keeps nothing else of a row.  A null text counts as
    empty, a null id comes first; an empty table stays empty.  Columns may have any name: those that are added take names that ``docs`` does not use.
    """
    sha, copy = unused(docs, "__sha"), unused(docs, "__copy")
    names = {"keep_id": "__keep_id", "text_sha256": "__keep_sha", "repeats": "__keep_repeats"}
    kept = cut(exact_duplicates(docs, id_col, text_col).where("kept").select(*(F.col(a).alias(b) for a, b in names.items())))
    named = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = (named[sha] == kept["__keep_sha"]) & named[id_col].cast("long").eqNullSafe(kept["__keep_id"])
    once = named.join(kept.where("__keep_repeats = 1"), same, "left_semi").select(*docs.columns)
    if kept.where("__keep_repeats > 1").isEmpty():
        return once
    # Rows alike in id and text: only these are sorted, to take the first of each.
    first = Window.partitionBy(sha, id_col).orderBy(sha)
    again = named.join(kept.where("__keep_repeats > 1"), same, "left_semi").withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1)
    return once.unionByName(again.select(*docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
