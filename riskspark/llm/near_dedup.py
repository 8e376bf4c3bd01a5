"""Near-duplicates by b-bit MinHash signatures and a multi-index Hamming join.

1. Sets and signatures: the distinct 5-word shingles of a whole text as 64-bit hashes, and the low 16 bits of
   the smallest value under each of 72 hash functions.  Texts with equal sets become one vertex, so exact copies cost nothing later on.
2. Multi-index: a signature of 72 positions is split into 12 chunks of 6.  Two signatures that differ in at most 23 positions have, by
   pigeonhole, a chunk with at most one error; each vertex therefore enters the index under every chunk with each one of its positions
   left out (72 keys).  A pair at Jaccard 0.75 differs in 18 positions on average; the chance that every one of its chunks has two
   errors or more is (1 - 0.75^6 - 6 * 0.25 * 0.75^5)^12 = 1e-4, at 0.8 it is 3e-6.
3. Stars: every vertex is paired with the smallest vertex of all its buckets, one pair each.  The pairs whose signatures are near are
   confirmed on full sets, and the links so found are closed to components.  In buckets that still hold several components, the smallest
   vertex of each component is paired with the smallest one of the bucket, and so on as before.
4. Rest: a bucket whose members are still in several components may hide links between them.  Only pairs of different components are
   looked at there: within their first common bucket (so once), first on the 72 positions, then on a wide signature of 2048 2-bit positions.
   Pairs within both distances are confirmed on full sets and components are closed again.  After that every pair that shares a bucket is in
   one component or was rejected, so no link within the index is lost, and no group is expanded to all its pairs.
5. Hot buckets: where more than BLOCK members meet, as pages of one template do, they are not compared with each other.  Their members
   get finer keys from their full sets: with shingles ordered by how many members hold them, rarest first, two sets at 0.75 or more share one
   of each one's first quarter (the prefix filter, which is exact).  What a template has in common is at the end of that order, so its pages part.
   Only a bucket of such a key that is itself larger than BLOCK is compared in tiles, spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import bitmap_of, cut, documents, drop, inside, mix, powers, seeded, slices, text_buffer, unused, word_hashes

WORDS = 5
CHUNKS, CHUNK = 12, 6
POSITIONS = CHUNKS * CHUNK
#: What the index is made for.
LEAST_PERCENT = 75
#: Signatures further apart than this are not at 0.75 (five standard deviations).
FAR = 38
#: Members of a bucket that are compared with each other at once.
BLOCK = 2048
#: Bits of the bitmaps of index keys and of ids, as powers of two: these at least, and 16 bits a key up to BITS_MOST (128 MB); beyond it more rows pass, none is lost.
KEY_BITS, ID_BITS, BITS_MOST = 26, 25, 30
#: The wide signature: 2-bit positions in 512 bytes; further apart than WIDE_FAR is not at 0.75 (384 expected, four and a half standard deviations).
WIDE, WIDE_FAR = 2048, 464
XOR, TIMES = seeded(101, POSITIONS), seeded(202, POSITIONS) | np.uint64(1)
WIDE_XOR, WIDE_TIMES = seeded(303, WIDE), seeded(404, WIDE) | np.uint64(1)
ROLL = powers(np.uint64(0x9FB21C651E98DF25), WORDS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per row; fewer words than ``words`` are one shingle, no words none."""
    hashes, at = word_hashes(data, offsets)
    out = []
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += hashes[k : k + n] * ROLL[k]
        rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * ROLL[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash signatures, one row per set; zeros for an empty set."""
    out = np.zeros((len(sets), POSITIONS), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[k] for k in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
        for j in range(POSITIONS):
            out[full, j] = mix(np.minimum.reduceat((values ^ XOR[j]) * TIMES[j], starts)).astype(np.uint16)
    return out


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        sizes, low, high, marks = [], [], [], []
        for a, b in slices(offsets):
            sets = shingle_sets(data, offsets[a : b + 1])
            sizes += map(len, sets)
            for s in sets:
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                low.append(int(digest[0]))
                high.append(int(digest[1]))
            marks += [row.tobytes() for row in signatures(sets)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "mark"])


def index_keys(marks: np.ndarray) -> np.ndarray:
    """Keys per signature: every chunk with each of its positions left out."""
    wide = marks.astype(np.uint64).reshape(len(marks), CHUNKS, CHUNK) * powers(np.uint64(0xA0761D6478BD642F), CHUNK)
    without = wide.sum(2, keepdims=True, dtype=np.uint64) - wide
    return mix(mix(without) + np.arange(POSITIONS, dtype=np.uint64).reshape(CHUNKS, CHUNK)).reshape(len(marks), POSITIONS)


def _index(batches: Iterable[pa.RecordBatch], shared=None) -> Iterator[pa.RecordBatch]:
    """key, vertex of every signature; with a bitmap of keys those that may be in it only."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            marks = np.frombuffer(b"".join(part.column("mark").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            keys = index_keys(marks).ravel()
            vertex = np.repeat(part.column("vertex").to_numpy(), POSITIONS)
            if shared is not None:
                ok = inside(shared.value, keys)
                keys, vertex = keys[ok], vertex[ok]
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(vertex)], ["key", "vertex"])


def _sets(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """vertex, shingles of the rows whose id may be in the bitmap."""
    for batch in batches:
        batch = batch.filter(pa.array(inside(shared.value, batch.column("vertex").to_numpy().astype(np.uint64))))
        data, offsets = text_buffer(batch.column("text"))
        for a, b in slices(offsets):
            sets = shingle_sets(data, offsets[a : b + 1])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vertex")[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["vertex", "shingles"])


def bits_for(keys: DataFrame, least: int) -> int:
    """Size of a bitmap for so many keys, as a power of two."""
    return min(BITS_MOST, max(least, (16 * keys.count()).bit_length()))


def sets_of(texts: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vertex, shingles``: the full sets of the vertices in ``vertices``, and by chance of some others.

    The wanted ids are a bitmap of fixed size, so texts are read where they lie and not shuffled; a full bitmap lets more rows pass but loses none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(vertices.select(F.col("vertex").alias("key")), bits_for(vertices, ID_BITS)))
    sets = cut(texts.select(F.col("doc_id").alias("vertex"), "text").where("vertex is not null").mapInArrow(lambda batches: _sets(batches, shared), "vertex long, shingles array<bigint>"))
    shared.destroy()
    return sets


def _close(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, POSITIONS) for n in ("a", "b"))
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        near = ((a != b).sum(1) <= FAR) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("hi")], ["lo", "hi"]).filter(pa.array(near))


def close_pairs(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs (lo, hi) whose sizes allow a link and whose signatures differ in at most FAR positions."""
    left = vertices.select(F.col("vertex").alias("lo"), F.col("mark").alias("a"), F.col("n_shingles").alias("n"))
    right = vertices.select(F.col("vertex").alias("hi"), F.col("mark").alias("b"), F.col("n_shingles").alias("m"))
    return cut(pairs.join(left, "lo").join(right, "hi").select("lo", "hi", "a", "b", "n", "m").mapInArrow(lambda batches: _close(batches, percent), "lo long, hi long").distinct())


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (lo, hi) with 100 * common >= percent * union on full sets."""
    left, right = sets.select(F.col("vertex").alias("lo"), F.col("shingles").alias("a")), sets.select(F.col("vertex").alias("hi"), F.col("shingles").alias("b"))
    sized = pairs.join(left, "lo").join(right, "hi").where(F.least(F.size("a"), F.size("b")) * 100 >= F.greatest(F.size("a"), F.size("b")) * percent)
    common = F.size(F.array_intersect("a", "b"))
    return cut(sized.where(common * 100 >= (F.size("a") + F.size("b") - common) * percent).select("lo", "hi").distinct())


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` (the smallest vertex reachable) for every vertex with a link.

    Alternating stars: large (every larger neighbour points to the smallest one), then small (every smaller neighbour and the vertex itself
    do).  Degrees of centres only shrink to one edge per vertex; each round is written to the shared folder and replaces the one before.
    """
    edges = cut(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).where("u > v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            out = cut(edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()))
            drop(edges)
            return out
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        drop(edges)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        drop(large)


def _wide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            sets = part.column("shingles")
            values = sets.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            starts = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
            least, room = np.empty((WIDE, part.num_rows), np.uint64), np.empty_like(values)
            for j in range(WIDE):
                np.bitwise_xor(values, WIDE_XOR[j], out=room)
                np.multiply(room, WIDE_TIMES[j], out=room)
                least[j] = np.minimum.reduceat(room, starts)
            bits = (mix(least.T) & np.uint64(3)).astype(np.uint8).reshape(part.num_rows, WIDE // 4, 4)
            out = (bits << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("vertex"), pa.array([row.tobytes() for row in out], pa.binary())], ["vertex", "wide"])


def wide_distance(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of 2-bit positions in which a wide signature (as 64-bit words) differs from each of the others."""
    x = others ^ one
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)


def _compare_blocks(rows: pa.Table) -> pa.Table:
    """Near pairs of one task's rows (key, finer, side, vertex, component, mark, wide): sides 0 and 1 against each other, or side 2 within itself."""
    side = rows.column("side").to_numpy()
    vertex, component = rows.column("vertex").to_numpy(), rows.column("component").to_numpy()
    marks = np.frombuffer(b"".join(rows.column("mark").to_pylist()), np.uint16).reshape(-1, POSITIONS)
    wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 32)
    bucket = np.int64(rows.column("key")[0].as_py()).astype(np.uint64)
    own = None if rows.column("finer")[0].as_py() else index_keys(marks) == bucket
    cross = bool((side < 2).any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(side)),) * 2
    lo, hi = [], []
    for n, i in enumerate(left):
        j = right if cross else right[n + 1 :]
        j = j[component[j] != component[i]]
        differ = marks[j] != marks[i]
        near = differ.sum(1) <= FAR
        j, differ = j[near], differ[near].reshape(-1, CHUNKS, CHUNK)
        if not len(j):
            continue
        if own is not None:
            # The first key that both have: the first chunk with at most one error, without the position of that error.
            errors = differ.sum(2)
            chunk = (errors <= 1).argmax(1)
            at = np.arange(len(j))
            place = np.where(errors[at, chunk] == 1, differ[at, chunk].argmax(1), 0)
            j = j[own[i, chunk * CHUNK + place]]
        j = j[wide_distance(wide[i], wide[j]) <= WIDE_FAR]
        lo.append(np.minimum(vertex[i], vertex[j]))
        hi.append(np.maximum(vertex[i], vertex[j]))
    lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi))
    return pa.table({"lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def mixed_rows(members: DataFrame, labels: DataFrame, finer: bool = False) -> DataFrame:
    """The members (key, finer, vertex, component, blocks) of the buckets that hold several components."""
    labelled = members.join(labels, "vertex", "left").select("key", "vertex", F.coalesce("component", "vertex").alias("component"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    mixed = cut(mixed.select("key", F.lit(finer).alias("finer"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = cut(labelled.join(mixed, "key"))
    drop(mixed)
    return rows


def star_pairs(rows: DataFrame) -> DataFrame:
    """In every bucket the smallest vertex of each component with the smallest vertex of the bucket."""
    of_component = rows.groupBy("key", "component").agg(F.min("vertex").alias("hi"))
    least = rows.groupBy("key").agg(F.min("vertex").alias("lo"))
    return of_component.join(least, "key").where("hi > lo").select("lo", "hi").distinct()


def finer_rows(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, vertex) of buckets keyed by the rarest shingles of the vertices of ``rows``, by the prefix filter.

    The shingles of a set are ordered by how many of these vertices hold them; two sets with 100 * common >= percent * union share one of the
    first ``n - ceil(n * percent / 100) + 1`` of each.  Shingles that one vertex alone holds take up places but make no rows.
    """
    mine = sets.join(rows.select("vertex").distinct(), "vertex", "left_semi").dropDuplicates(["vertex"])
    each = mine.select("vertex", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    several = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    ordered = each.join(several, "key").groupBy("vertex").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("c", "key"))).alias("shared"))
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    return ordered.where(room > 0).select("vertex", F.explode(F.slice("shared", F.lit(1), room.cast("int"))).alias("s")).select("s.key", "vertex")


def hidden_pairs(rows: DataFrame, both: DataFrame) -> DataFrame:
    """Pairs (lo, hi) of different components within the buckets of ``rows``."""
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    # A tile is a pair of blocks (i <= j); with one block that is the bucket itself.
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("side")))
    tiled = rows.withColumn("own", own).select("key", "finer", F.explode(tiles).alias("t"), "vertex", "component").select("key", "finer", "t.i", "t.j", "t.side", "vertex", "component")
    return cut(tiled.join(both, "vertex").groupBy("key", "finer", "i", "j").applyInArrow(_compare_blocks, "lo long, hi long").distinct())


def stars_of(labels: DataFrame) -> DataFrame:
    return labels.where("vertex > component").select(F.col("component").alias("lo"), F.col("vertex").alias("hi"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable over links with 100 * common >= percent * union of the shingle sets.  Null and
    empty texts and texts without words have no shingles and no links.  Rows that repeat an id are one vertex with the links of all its rows; a null
    id has no links and a null component.  Ties do not matter: a bucket's smallest vertex is by id.  A long text is one row, and its set
    one array.  An empty table gives no rows.  Only the two named columns are read.

    Chunks and distances are made for 75 percent.  Above it they find the same pairs with more certainty; below it they would lose some, so that is an error.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must lie between {LEAST_PERCENT} and 100: the index is made for {LEAST_PERCENT}")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(_sign, "doc_id long, n_shingles long, d1 long, d2 long, mark binary"))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    vertices = cut(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("vertex"), F.first("n_shingles").alias("n_shingles"), F.first("mark").alias("mark")))
    marks = vertices.select("vertex", "mark")
    buckets = cut(marks.mapInArrow(_index, "key long, vertex long").groupBy("key").agg(F.min("vertex").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"))
    shared = spark.sparkContext.broadcast(bitmap_of(buckets, bits_for(buckets, KEY_BITS)))
    members = cut(marks.mapInArrow(lambda batches: _index(batches, shared), "key long, vertex long").join(buckets, "key"))
    drop(buckets)
    shared.destroy()

    def linked(pairs: DataFrame) -> DataFrame:
        near = close_pairs(pairs, vertices, percent)
        sets = sets_of(texts, near.select(F.explode(F.array("lo", "hi")).alias("vertex")))
        links = confirm(near, sets, percent)
        drop(near, sets)
        return links

    links = linked(members.where("vertex > least").groupBy("vertex").agg(F.min("least").alias("lo")).withColumnRenamed("vertex", "hi"))
    labels = components(links)
    rows = mixed_rows(members, labels)
    more = linked(star_pairs(rows))
    labels_2 = components(stars_of(labels).unionByName(more))
    drop(links, labels, rows, more)
    rows = mixed_rows(members, labels_2)
    drop(members)
    sets = sets_of(texts, rows)
    wide = sets.join(rows.select("vertex").distinct(), "vertex", "left_semi").dropDuplicates(["vertex"]).mapInArrow(_wide, "vertex long, wide binary")
    both = cut(marks.join(wide, "vertex"))
    finer = mixed_rows(finer_rows(rows.where("blocks > 1"), sets, percent), labels_2, finer=True)
    hidden = hidden_pairs(rows.where("blocks = 1").unionByName(finer), both)
    more = confirm(hidden, sets, percent)
    drop(rows, finer, both, hidden, sets)
    labels = components(stars_of(labels_2).unionByName(more))
    drop(labels_2, more)
    # Back to rows: a row's vertex is that of its set.
    of_set = vertices.join(labels, "vertex", "left").select("d1", "d2", F.coalesce("component", "vertex").alias("found"))
    joined = signed.drop("mark").join(of_set, ["d1", "d2"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their own columns, whatever their names; rows with a null id stay.

    Null and empty texts have no links, so they stay; rows that repeat an id stay or go together; an empty table stays empty.
    """
    gone = cut(near_duplicates(docs, id_col, text_col, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(unused(docs, "__gone"))).distinct())
    return docs.join(gone, docs[id_col].cast("long") == gone[gone.columns[0]], "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
