"""Language-model scores from a probabilistic suffix tree over words.

Symbols are words (A-Z lowered) and one end per text.  The root holds add-one word probabilities.  A node is a
context of one to DEPTH words:

* candidates are contexts and pairs (context, next symbol) seen LEAST times, at every size of the corpus;
* a candidate is retained if its next-symbol distribution diverges from that of its longest retained suffix: count * Kullback-Leibler
  divergence >= DIVERGENCE nats;
* smoothing: kept symbols have (count - DISCOUNT) / context count, all others the suffix's probability times
  what is left, so that every distribution sums to one over the vocabulary and one unknown word.

A text is scored by the longest retained suffix of what came before each token.

DEPTH, LEAST, DIVERGENCE and DISCOUNT are arguments of ``fit`` and ``score_documents``; a deeper tree costs one more pass over the text per step.

At scale: the counts of words and of sequences of two to DEPTH + 1 words (a context and its next symbol) are Spark tables that grow with the
text, summed per task in NumPy, then by Spark.  A sequence can only be seen LEAST times if both sequences one word shorter are, so
positions are dropped early by a bitmap of those; it is of fixed size, and a full one drops less but loses nothing.  The logarithm of a probability is a sum of
one weight per sequence that ends at a token, so each weight is looked up on its own: the head (words with a share of at least HEAD, longer
sequences of at least SHARE, so at most 1 / share of them) is broadcast, all others, whose counts are low and so free of skew, meet their
weights in a shuffle join, and texts add up the parts.  The shares decide where a weight is looked up, not what it is.
What is counted or looked up moves in packets, one per piece of text and part of the key space, so Spark shuffles thousands of binary rows in place of
millions of small ones.  Every piece of text has a number, and a row its place in the piece, so no two rows can be mixed up; logarithms are summed as
whole multiples of 1 / UNIT, so sums do not depend on the order of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import BITS, bitmap_of, cut, documents, drop, inside, mix, remainder, slices, text_buffer, word_hashes

DEPTH = 3
HEAD, SHARE = 2e-7, 1e-6
LEAST = 3
DIVERGENCE, DISCOUNT = 20.0, 0.5
END = np.uint64(0x5851F42D4C957F2D)
STEP = np.uint64(0xC6A4A7935BD1E995)
#: Local sums are passed on when they have more entries than this.
HOLD = 1 << 20
#: Logarithms are added up in units of 1 / UNIT.
UNIT = 1 << 34


class Table:
    """64-bit keys to rows of an array, by open addressing; looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.rows = np.full(int(self.mask) + 1, -1, np.int32)
        left = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        step = np.uint64(0)
        while len(left):
            slot = ((keys[left] + step) & self.mask).astype(np.int64)
            free = self.rows[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            at = slot[free][first]
            self.keys[at], self.rows[at] = keys[put], put
            left = left[~np.isin(left, put, assume_unique=True)]
            step += np.uint64(1)
        self.steps = int(step)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        out = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        for step in range(self.steps):
            slot = ((keys[left] + np.uint64(step)) & self.mask).astype(np.int64)
            rows, same = self.rows[slot], self.keys[slot] == keys[left]
            hit = (rows >= 0) & same
            out[left[hit]] = rows[hit]
            left = left[(rows >= 0) & ~same]
            if not len(left):
                break
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end behind each row, each token's place in its row, and n + 1 offsets."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at) + 1
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(edges[-1]), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[edges[1:] - 1] = False
    out[inner] = words
    return out, np.arange(len(out)) - np.repeat(edges[:-1], counts), edges


def grams(symbols: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... ``most`` symbols that end at each position (meaningless where the row has fewer)."""
    out = [symbols]
    for _ in range(most - 1):
        longer = out[-1].copy()
        longer[1:] = joint(out[-1][:-1], out[-1][1:])
        out.append(longer)
    return out


def contexts(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` symbols before each position (meaningless in a row's first ``depth`` places)."""
    return np.roll(grams(symbols, depth)[-1], 1)


def joint(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of all its symbols but the last, and but the first."""
    return mix(first * STEP + last)


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for a, b in slices(offsets, 1 << 20):
            yield tokens(data, offsets[a : b + 1])


#: Parts of the key space: a key belongs to the one that its leading bits name.  There are 2^PART_BITS of them at least, and as many more as keep a part to PART_BYTES of text.
PART_BITS, PART_BYTES = 10, 1 << 26


def bits_of(texts: DataFrame) -> int:
    """Leading bits that name a part, from the bytes of all texts: what a task holds of a part stays the same at every size."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(30, max(PART_BITS, (size // PART_BYTES).bit_length()))


def packets(bits: int, keys: np.ndarray, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """Parts of the key space, and for each part the columns' values as bytes, in one order for all columns."""
    part = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    present, first = np.unique(part[order], return_index=True)
    edges = np.append(first, len(keys))
    return pa.array(present), [packed(x[order], edges) for x in columns]


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values[edges[k] : edges[k + 1]]``."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packets without nulls, and how many each packet has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data.to_pybytes() if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(values.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _summed(batches: Iterable[pa.RecordBatch], rows_of: Callable, width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Packets of sums by key per task: ``rows_of(symbols, place)`` gives an array of 64-bit columns whose first is the key; the last ``width`` are passed on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        rows, counts = np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held])
        _, first, back = np.unique(rows[:, 0], return_index=True, return_inverse=True)
        return rows[first], np.bincount(back, counts).astype(np.int64)

    def out(rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part, columns = packets(bits, rows[:, 0], *(rows[:, k - width] for k in range(width)), counts)
        return pa.RecordBatch.from_arrays([part, *columns], ["part", *(f"k{k}" for k in range(width)), "c"])

    size = 0
    for symbols, place, _ in _each(batches):
        rows = rows_of(symbols, place)
        if not len(rows):
            continue
        _, first, counts = np.unique(rows[:, 0], return_index=True, return_counts=True)
        held.append((rows[first], counts))
        size += len(first)
        if size > 2 * HOLD:
            held = [merge()]
            size = len(held[0][0])
            if size > HOLD:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*merge())


def _merged(batches: Iterable[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Whole sums by key of some parts of the key space, of ``least`` at least."""
    names = [f"k{k}" for k in range(width)]
    held = [[unpacked(batch.column(n), np.uint64)[0] for n in names] + [unpacked(batch.column("c"), np.int64)[0]] for batch in batches]
    if not held:
        return
    *ks, c = (np.concatenate(x) for x in zip(*held, strict=True))
    key = joint(*ks) if width == 2 else ks[0]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    c = np.add.reduceat(c[order], first) if len(first) else c
    ok = c >= least
    at, c = first[ok], c[ok]
    columns = ([key[at]] if width == 2 else []) + [k[order[at]] for k in ks]
    for a in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([*(pa.array(x[a : a + (1 << 16)].astype(np.int64)) for x in columns), pa.array(c[a : a + (1 << 16)])], [*(["key"] if width == 2 else []), *names, "c"])


def _count(texts: DataFrame, rows_of: Callable, width: int, bits: int, least: int = 1) -> DataFrame:
    """``k0, c`` (one column of keys) or ``key, k0, k1, c``: a partition of the shuffle holds its parts' sums at once, so the number of shuffle partitions bounds memory."""
    names = [f"k{k}" for k in range(width)]
    sums = texts.mapInArrow(lambda batches: _summed(batches, rows_of, width, bits), "part int, " + "".join(f"{n} binary, " for n in names) + "c binary")
    return sums.repartition("part").mapInArrow(lambda batches: _merged(batches, width, least), ("key long, " if width == 2 else "") + ", ".join(f"{n} long" for n in names) + ", c long")


class Tree:
    """The root and the head of the weights: per number of symbols, sequence -> (gain as the end of a context, factor as a context)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int, depth: int = DEPTH):
        self.total, self.distinct, self.depth = total, distinct, depth
        self.scale = float(total + distinct + 1)
        self.words, self.counts = Table(words), counts
        self.root = (counts + 1) / self.scale
        self.nodes: list[tuple[Table, np.ndarray]] = []  # per depth: context -> what is left for other symbols, as a factor
        self.pairs: list[tuple[Table, np.ndarray]] = []  # per depth: context and symbol -> probability, in units of what it is without this node
        self.more = np.zeros(1 << (BITS - 5), np.uint32)  # sequences with a weight

    def probabilities(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token: its row in the head (-1: not there), and its probability by the head, in units of its root probability if it is not in the head."""
        row = self.words.find(symbols)
        p = np.where(row >= 0, self.root[np.maximum(row, 0)] if len(self.root) else 1.0, 1.0)
        found = grams(symbols, self.depth + 1)
        for k, (nodes, pairs) in enumerate(zip(self.nodes, self.pairs)):
            at = np.flatnonzero(place > k)
            for (table, weight), keys in ((nodes, found[k][at - 1]), (pairs, found[k + 1][at])):
                hit = table.find(keys)
                p[at[hit >= 0]] *= weight[hit[hit >= 0]]
        return row, p

    def elsewhere(self, symbols: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and keys (words, then longer sequences) whose weights may be outside the head."""
        at = np.flatnonzero(self.words.find(symbols) < 0)
        yield at, symbols[at]
        found = grams(symbols, self.depth + 1)
        for k, (pairs, _) in enumerate(self.pairs):
            at = np.flatnonzero(place > k)
            at = at[inside(self.more, found[k + 1][at])]
            at = at[pairs.find(found[k + 1][at]) < 0]
            yield at, found[k + 1][at]


def fit(texts: DataFrame, **how) -> tuple[Tree, DataFrame]:
    """The head of the tree learned from ``text`` of all rows, and the table of all words (k0, c, factor)."""
    return _fit(texts, **how)[:2]


def _fit(texts: DataFrame, most: int = DEPTH, least: int = LEAST, least_divergence: float = DIVERGENCE, discount: float = DISCOUNT, bits: int | None = None) -> tuple[Tree, DataFrame, DataFrame]:
    """The head of the tree, all words (k0, c, factor) and all longer sequences with a weight (key, c, gain, factor)."""
    bits = bits_of(texts) if bits is None else bits
    counts = cut(_count(texts, lambda symbols, place: symbols.reshape(-1, 1), 1, bits))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    scale = float(total + distinct + 1)
    sc = texts.sparkSession.sparkContext
    # Sequences of ``depth`` symbols seen often enough, with the probability p of the last one.
    known = counts.where(F.col("c") >= least).select(F.col("k0").alias("key"), "c", ((F.col("c") + 1) / F.lit(scale)).alias("p"), F.lit(1.0).alias("gain"))
    levels, nodes = [known], []
    for depth in range(1, most + 1):
        shared = sc.broadcast(bitmap_of(known))

        def rows_of(symbols: np.ndarray, place: np.ndarray, depth=depth, shared=shared) -> np.ndarray:
            keys = grams(symbols, depth)[-1]
            ok = inside(shared.value, keys)
            at = np.flatnonzero(place >= depth)
            at = at[ok[at] & ok[at - 1]]
            return np.stack([joint(keys[at - 1], keys[at]), keys[at - 1], keys[at]], 1)

        counted = cut(_count(texts, rows_of, 2, bits, least))
        pairs = cut(counted.join(known.select(F.col("key").alias("k1"), F.col("p").alias("lower")), "k1").select("key", F.col("k0").alias("context"), "c", "lower"))
        share = F.col("c") - discount
        sums = pairs.groupBy("context").agg(F.sum(share).alias("a"), F.sum("lower").alias("below"), F.sum(share * F.log(share / F.col("lower"))).alias("s"))
        sized = sums.join(known.select(F.col("key").alias("context"), F.col("c").alias("size")), "context")
        # kept < 1 because of the discount; a context that is not where its counts say is left out.
        rest, rest_below = F.greatest(1 - F.col("a") / F.col("size"), F.lit(1e-12)), F.greatest(1 - F.col("below"), F.lit(1e-12))
        divergence = F.col("s") - F.col("a") * F.log("size") + F.col("size") * rest * F.log(rest / rest_below)
        good = (divergence >= least_divergence) & (F.col("a") < F.col("size")) & (F.col("below") < 1)
        nodes.append(cut(sized.where(good).select("context", "size", (rest / rest_below).alias("factor"))))
        p = share / F.col("size")
        joined = pairs.join(nodes[-1], "context", "left")
        known = cut(joined.select("key", "c", F.coalesce(p, "lower").alias("p"), F.coalesce(p / (F.col("lower") * F.col("factor")), F.lit(1.0)).alias("gain")))
        levels.append(known)
        shared.destroy()
        drop(counted, pairs)
    word = counts.join(nodes[0].select(F.col("context").alias("k0"), "factor"), "k0", "left").select("k0", "c", F.coalesce("factor", F.lit(1.0)).alias("factor"))
    words = cut(word)
    drop(counts)
    longer = [level.join(node.select(F.col("context").alias("key"), "factor"), "key", "left") for level, node in zip(levels[1:-1], nodes[1:])] + [levels[-1].withColumn("factor", F.lit(1.0))]
    weights = None
    for n, df in enumerate(longer, 2):
        df = df.select(F.lit(n).alias("n"), "key", "c", "gain", F.coalesce("factor", F.lit(1.0)).alias("factor")).where("gain <> 1 or factor <> 1")
        weights = df if weights is None else weights.unionByName(df)
    weights = cut(weights)
    drop(*levels[1:], *nodes)
    unsigned = lambda x: x.to_numpy(np.int64).astype(np.uint64)
    head = words.where(F.col("c") >= max(1.0, HEAD * total)).toPandas()
    tree = Tree(unsigned(head["k0"]), head["c"].to_numpy(np.int64), total, distinct, most)
    heads = weights.where(F.col("c") >= SHARE * total).toPandas()
    tables = [(tree.words, None, head["factor"].to_numpy(float))]
    for n in range(2, most + 2):
        part = heads[heads["n"] == n]
        tables.append((Table(unsigned(part["key"])), part["gain"].to_numpy(float), part["factor"].to_numpy(float)))
    tree.nodes = [(table, factor) for table, _, factor in tables[:-1]]
    tree.pairs = [(table, gain) for table, gain, _ in tables[1:]]
    tree.more = bitmap_of(weights)
    return tree, words, weights


#: Packets on their way to the part of the key space where weights lie (kinds 0: weights, 1: requests, 2: rows with what the head says).
PACKETS = "part int, kind int, piece long, a binary, b binary, c binary, d binary, e binary"
NAMES = [x.split()[0] for x in PACKETS.split(", ")]
WORD_BIT = np.uint32(1 << 31)


def _packet_rows(part: pa.Array, kind: int, piece: int, *columns: pa.Array) -> pa.RecordBatch:
    n = len(part)
    empty = pa.array([b""] * n, pa.binary())
    return pa.RecordBatch.from_arrays([part.cast(pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, piece, np.int64)), *columns, *[empty] * (5 - len(columns))], NAMES)


def _requests(batches: Iterable[pa.RecordBatch], tree, bits: int) -> Iterator[pa.RecordBatch]:
    """Per piece of text one packet with what the head says of its rows, and packets of (row, key) for every word outside the head and every
    longer sequence that may have a weight outside the head."""
    tree, piece = tree.value, TaskContext.get().partitionId() << 36
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids = batch.column("doc_id")
        known_id, ids = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy()
        for a, b in slices(offsets, 1 << 20):
            symbols, place, edges = tokens(data, offsets[a : b + 1])
            found, p = tree.probabilities(symbols, place)
            base = np.where(found >= 0, np.log10(tree.root[np.maximum(found, 0)]) if len(tree.root) else 0.0, 0.0)
            known, base, score = (np.add.reduceat(x, edges[:-1]) for x in ((found >= 0).astype(np.int64), base, np.log10(p)))
            every = np.array([0, b - a])
            rows = [ids[a:b], known_id[a:b] + 2 * np.diff(edges), known, np.rint(base * UNIT).astype(np.int64), np.rint(score * UNIT).astype(np.int64)]
            yield _packet_rows(pa.array([piece % (1 << bits)]), 2, piece, *(packed(x, every) for x in rows))
            wanted = list(tree.elsewhere(symbols, place))
            keys = np.concatenate([k for _, k in wanted])
            owner = np.concatenate([(np.searchsorted(edges, at, "right") - 1).astype(np.uint32) | (WORD_BIT if k == 0 else np.uint32(0)) for k, (at, _) in enumerate(wanted)])
            if len(keys):
                part, columns = packets(bits, keys, owner, keys)
                yield _packet_rows(part, 1, piece, *columns)
            piece += 1


def _weights(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key").to_numpy().astype(np.uint64)
            part, columns = packets(bits, keys, keys, batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("base").to_numpy(), batch.column("weight").to_numpy())
            yield _packet_rows(part, 0, 0, *columns)


def _resolved(batches: Iterable[pa.RecordBatch], unknown: int) -> Iterator[pa.RecordBatch]:
    """Packets of sums per piece (kind 1), and the rows of kind 2 as they come.  ``unknown``: what a word without a weight adds."""
    weights, requests = [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        if (kind == 2).any():
            yield batch.filter(pa.array(kind == 2))
        part = batch.filter(pa.array(kind == 0))
        weights.append([unpacked(part.column(c), t)[0] for c, t in zip("abcd", (np.uint64, np.uint8, np.int64, np.int64), strict=True)])
        part = batch.filter(pa.array(kind == 1))
        owner, n = unpacked(part.column("a"), np.uint32)
        requests.append([np.repeat(part.column("piece").to_numpy(), n), owner, unpacked(part.column("b"), np.uint64)[0]])
    if not requests:
        return
    piece, owner, wanted = (np.concatenate(x) for x in zip(*requests, strict=True))
    if not len(wanted):
        return
    keys, word, base, weight = (np.concatenate(x) for x in zip(*weights, strict=True))
    order = np.lexsort((word, keys))
    keys, word, base, weight = keys[order], word[order], base[order], weight[order]
    is_word = (owner & WORD_BIT) != 0
    # A word and a longer sequence may share a key; they lie next to each other then.
    at = np.searchsorted(keys, wanted)
    for _ in range(2):
        inside_ = at < len(keys)
        next_ = inside_.copy()
        next_[inside_] = (keys[at[inside_]] == wanted[inside_]) & (word[at[inside_]] != is_word[inside_])
        at[next_] += 1
    hit = at < len(keys)
    hit[hit] = (keys[at[hit]] == wanted[hit]) & (word[at[hit]] == is_word[hit])
    to_base = np.where(is_word, unknown, 0).astype(np.int64)
    to_base[hit] = base[at[hit]]
    to_score = to_base.copy()
    to_score[hit] += weight[at[hit]]
    row = (owner & ~WORD_BIT).astype(np.int64)
    order = np.lexsort((row, piece))
    piece, row = piece[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])]))
    sums = [np.add.reduceat(x[order], first) for x in ((hit & is_word).astype(np.int64), to_base, to_score)]
    piece, row = piece[first], row[first]
    heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    edges = np.append(heads, len(piece))
    empty = pa.array([b""] * len(heads), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(heads), np.int32)), pa.array(np.ones(len(heads), np.int32)), pa.array(piece[heads]), packed(row.astype(np.uint32), edges), *(packed(x, edges) for x in sums), empty], NAMES)


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the packets of whole pieces."""
    rows: dict[int, list[np.ndarray]] = {}
    more: list[tuple[int, list[np.ndarray]]] = []
    for batch in batches:
        for kind, piece, *columns in zip(*(batch.column(n).to_pylist() for n in ("kind", "piece", "a", "b", "c", "d", "e")), strict=True):
            if kind == 2:
                rows[piece] = [np.frombuffer(x, np.int64).copy() for x in columns]
            else:
                more.append((piece, [np.frombuffer(columns[0], np.uint32), *(np.frombuffer(x, np.int64) for x in columns[1:4])]))
    for piece, (row, *sums) in more:
        for to, x in zip(rows[piece][2:], sums, strict=True):
            to[row] += x  # a packet has a row once
    for ids, n, known, base, score in rows.values():
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=n % 2 == 0), pa.array(n // 2), pa.array(known), pa.array(base / UNIT), pa.array(score / UNIT)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, **how) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row, learned from the rows where ``learn`` holds.

    ``how``: most (words of the longest context), least, least_divergence, discount.  ``bits``: leading bits of a key that name its part, by default from the size of the texts.  Null and empty texts are one end. Without training rows every
    token is unknown and has probability 1. Rows that repeat id and text get the same scores; a null id stays null. A long text is scored
    whole, in the task that reads it. An empty table gives no rows. Other columns are not read.  ``docs`` should be a table or a narrow
    selection of one, whose rows a retried task reads in the same order.
    """
    bits = bits_of(docs.select(F.col(text_col).alias("text"))) if bits is None else bits
    tree, words, weights = _fit(docs.where(learn).select(F.col(text_col).alias("text")), bits=bits, **how)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    requests = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: _requests(batches, shared, bits), PACKETS)
    fixed = lambda x: F.round(x * UNIT).cast("long")
    root, none = F.log10((F.col("c") + 1) / F.lit(tree.scale)), F.lit(0).cast("long")
    table = words.where(F.col("c") < max(1.0, HEAD * tree.total)).select(F.col("k0").alias("key"), F.lit(True).alias("word"), fixed(root).alias("base"), fixed(F.log10("factor")).alias("weight"))
    table = table.unionByName(weights.where(F.col("c") < SHARE * tree.total).select("key", F.lit(False).alias("word"), none.alias("base"), fixed(F.log10(F.col("gain") * F.col("factor"))).alias("weight")))
    unknown = round(-np.log10(tree.scale) * UNIT)
    met = requests.unionByName(table.mapInArrow(lambda batches: _weights(batches, bits), PACKETS)).repartition("part").mapInArrow(lambda batches: _resolved(batches, unknown), PACKETS)
    scored = met.repartition("piece").mapInArrow(_together, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(documents(spark, sf_dir), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
