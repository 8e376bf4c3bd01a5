"""Labels, augmentation, hashed features, training and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.text import clamp, risk_level
from riskspark.operators.features import gram_hashes
from riskspark.operators.metrics import ranged
from riskspark.operators.score import blend
from riskspark.session import drop, materialise, small_batches, whole_files

#: Hashed features and numeric slots; training settings.
BUCKETS, EPOCHS, RATE = 4096, 12, 0.01


def label_weight(score: Column) -> Column:
    """Distance to the nearest inner threshold over half its band's width, within [0.2, 1]."""
    distance = F.least(*[F.abs(score - x) for x in (40.0, 65.0, 88.0)])
    half = F.when(score < 40, 20.0).when(score < 65, 12.5).when(score < 88, 11.5).otherwise(6.0)
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), distance / half))


def weak_labels(scores: DataFrame) -> DataFrame:
    """``case_id, risk, is_scam, weight, category`` and the eight dimensions as shares, from rule scores."""
    risk = F.col("score") / 100
    return scores.select("case_id", risk.alias("risk"), (risk >= 0.5).alias("is_scam"), label_weight(F.col("score").cast("double")).alias("weight"), "category", *[(F.col(d) / 100).alias(d) for d in config.DIMENSIONS])


def hand_labels(given: DataFrame, weak: DataFrame) -> DataFrame:
    """Hand-made labels (case_id, risk, is_scam, category) as label rows of weight 1: their dimensions are those of the rules on the same case's text (``weak``), 0 where the rules know it not."""
    dims = weak.select("case_id", *config.DIMENSIONS)
    return given.select("case_id", "risk", "is_scam", "category").join(dims, "case_id", "left").select("case_id", "risk", "is_scam", F.lit(1.0).alias("weight"), "category", *[F.coalesce(d, F.lit(0.0)).alias(d) for d in config.DIMENSIONS])


def merge_labels(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Hand-made labels over weak ones, by case, with ``source`` (gold, weak)."""
    own = weak.join(strong.select("case_id"), "case_id", "left_anti").withColumn("source", F.lit("weak"))
    return strong.withColumn("source", F.lit("gold")).unionByName(own)


def training_table(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """``case_id, y`` and the dimensions within [0, 1], ``category`` (its index; unknown ones are 0), ``weight`` (not below 0) for every case; one without a label has zeros."""
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    index = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORY_NAMES) for x in (c, k)]), F.coalesce("category", F.lit(""))), F.lit(0))
    joined = cases.select("case_id").join(labels, "case_id", "left")
    return joined.select("case_id", share("risk").alias("y"), *[share(d).alias(d) for d in config.DIMENSIONS], index.alias("category"), F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))


def stratified_split(df: DataFrame, key: str, stratum: str, part: float = 0.15, seed: int = 7, cells: int = 1024) -> DataFrame:
    """``held`` for the first ``part`` of every stratum (one row at least) in the order of a seeded hash of the key.

    Rows are counted by stratum and cell (leading bits of the hash).  A stratum's quota ends within one cell, so whole cells are settled by the
    counts, and only the rows of that one are ordered: no stratum goes through one task, however large.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__cell", F.floor(F.pmod(F.shiftright("__h", 16), F.lit(cells))))
    counts = hashed.groupBy(stratum, "__cell").agg(F.count("*").alias("n"))  # ``cells`` rows per stratum
    w = Window.partitionBy(stratum)
    before = F.sum("n").over(w.orderBy("__cell")) - F.col("n")
    quota = F.greatest(F.lit(1), F.floor(F.sum("n").over(w) * part))
    bounds = counts.select(F.col(stratum).alias("__s"), F.col("__cell").alias("__c"), F.col("n").alias("__n"), (quota - before).alias("__left"))
    placed = hashed.join(bounds, hashed[stratum].eqNullSafe(bounds["__s"]) & (hashed["__cell"] == bounds["__c"]))
    split = (F.col("__left") > 0) & (F.col("__left") < F.col("__n"))
    order = Window.partitionBy(stratum, "__cell").orderBy("__h", key)
    settled = placed.where(~split).withColumn("held", F.col("__left") > 0)
    ordered = placed.where(split).withColumn("held", F.row_number().over(order) <= F.col("__left"))
    return settled.unionByName(ordered).select(*df.columns, "held")


def codemix(text: Column, key: Column, clauses: tuple[str, ...], rate: int = 3) -> Column:
    """A clause appended to one row in ``rate``, chosen by the key."""
    clause = F.element_at(F.array(*map(F.lit, clauses)), (key % len(clauses) + 1).cast("int"))
    return F.when(key % rate == 0, F.concat_ws(" ", text, clause)).otherwise(text)


def graded_risk(intent: Column, themes: Column) -> Column:
    """Five tiers by intent and number of themes."""
    return F.when(~intent, 0.08).when(themes >= 4, 0.95).when(themes == 3, 0.86).when(themes == 2, 0.74).otherwise(0.58)


def surface_dedup(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per surface (the smallest key): a digest is shuffled, not the texts."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns]), 256)
    return df.select(key, digest.alias("surface")).groupBy("surface").agg(F.min(key).alias(key), F.count("*").alias("n"))


# Letters and the signs that look like them; letters and the digits or signs written for them; what is put between letters, and between words.
LOOKALIKE_FROM, LOOKALIKE_TO = "аоерсхкмнтву", "aoepcxkmhtby"
DIGITS_FROM, DIGITS_TO = "озэичаб", "03314@6"
SEPARATORS, EMOJI = (" ", ".", "-", "\u200b"), ("🔥", "💰", "🤑", "✅", "💸", "🚀", "🎰", "⚡", "💎")
# Chances of a long word to be changed at all, of each kind of change, of a letter within it, of an emoji behind a word; changes of a word at most; shortest word.
WORD_CHANGED, EMOJI_AFTER, CHANGES_MOST, WORD_LEAST = 0.55, 0.12, 2, 4
KINDS = {"lookalike": (0.6, 0.5), "digits": (0.5, 0.45), "doubling": (0.25, 0.3), "spacing": (0.30, None)}


def draw(*of: Column | int | str) -> Column:
    """A number in [0, 1) that a hash of all arguments gives."""
    return F.pmod(F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in of]), F.lit(1 << 30)) / float(1 << 30)


def picked(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(at * len(values)).cast("int") + 1)


def _change(word: Column, kind: Column, letter: Callable[[str, Column], Column], separator: Column) -> Column:
    """``word`` after one kind of change; ``letter(kind, place)`` draws for a letter."""
    letters = F.split(word, "")

    def swapped(name: str, source: str, target: str) -> Column:
        return F.array_join(F.transform(letters, lambda c, j: F.when(letter(name, j) < KINDS[name][1], F.translate(c, source, target)).otherwise(c)), "")

    doubled = F.array_join(F.transform(letters, lambda c, j: F.when(c.rlike(r"^\p{L}$") & (letter("doubling", j) < KINDS["doubling"][1]), F.concat(c, c)).otherwise(c)), "")
    return F.when(kind == "lookalike", swapped("lookalike", LOOKALIKE_FROM, LOOKALIKE_TO)).when(kind == "digits", swapped("digits", DIGITS_FROM, DIGITS_TO)).when(kind == "doubling", doubled).otherwise(F.call_function("array_join", letters, separator))


def disguised(text: Column, key: Column, seed: int = 13) -> Column:
    """``text`` with about half of its longer words changed, in at most two of four ways each, and emoji between words; all draws follow from key, place and seed."""

    def one(word: Column, i: Column) -> Column:
        kinds = F.array_compact(F.array(*[F.when(draw(seed, key, i, name) < chance, F.struct(draw(seed, key, i, name, "order").alias("order"), F.lit(name).alias("name"))) for name, (chance, _) in KINDS.items()]))
        chosen = F.transform(F.slice(F.array_sort(kinds), 1, CHANGES_MOST), lambda k: k["name"])
        changed = F.aggregate(chosen, word, lambda w, kind: _change(w, kind, lambda name, j: draw(seed, key, i, name, j), picked(SEPARATORS, draw(seed, key, i, "separator"))))
        out = F.when((F.length(word) >= WORD_LEAST) & (draw(seed, key, i, "word") < WORD_CHANGED), changed).otherwise(word)
        return F.when(draw(seed, key, i, "emoji") < EMOJI_AFTER, F.concat(out, F.lit(" "), picked(EMOJI, draw(seed, key, i, "which")))).otherwise(out)

    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")


def obfuscated_twins(df: DataFrame, positive: Column, key: str = "case_id", text: str = "text", rate: float = 0.45, seed: int = 13) -> DataFrame:
    """Disguised twins of a share ``rate`` of the positive rows, with all other columns (the labels) of their parents; a twin that is empty or like its parent is none."""
    chosen = df.where(positive & (draw(seed, F.col(key), "twin") < rate)).withColumn("__was", F.coalesce(text, F.lit("")))
    return chosen.withColumn(text, disguised(F.col("__was"), F.col(key), seed)).where((F.col(text) != F.col("__was")) & (F.trim(text) != "")).drop("__was")


def augmented(df: DataFrame, positive: Column, key: str = "case_id", text: str = "text", rate: float = 0.45, seed: int = 13) -> DataFrame:
    """All rows and their twins, with ``twin`` to tell them; equal texts are left as they are (``surface_dedup`` drops them)."""
    return df.withColumn("twin", F.lit(False)).unionByName(obfuscated_twins(df, positive, key, text, rate, seed).withColumn("twin", F.lit(True)))


def hashed_features(grams: DataFrame, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """``case_id, bucket, value``: signed hashing of grams, scaled to length 1 per case."""
    summed = grams.select("case_id", bucket_of(F.col("gram"), buckets, seed).alias("bucket"), sign_of(F.col("gram"), seed).alias("s")).groupBy("case_id", "bucket").agg(F.sum("s").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("case_id")))
    return summed.select("case_id", "bucket", (F.col("v") / norm).alias("value"))


#: Rows, and characters of their texts, that are summed at once.
ROWS, CHARACTERS = 256, 1 << 20


def _summed(case: pa.Array, rows: np.ndarray, found: np.ndarray, values: np.ndarray, buckets: int, scaled: bool) -> pa.RecordBatch:
    """``case_id, idx, val``: per row the values of equal buckets added up, in rising order of buckets, those of 0 left out; ``scaled`` to length 1.  ``rows``: the row of each pair, rising where there are more than ROWS."""
    out, sizes = [], np.zeros(len(case), np.int64)
    for a in range(0, len(case), ROWS):
        n = min(ROWS, len(case) - a)
        part = slice(None) if len(case) <= ROWS else slice(*np.searchsorted(rows, (a, a + n)))
        total = np.bincount((rows[part] - a) * buckets + found[part], values[part], n * buckets)
        at = np.flatnonzero(total)
        total, row = total[at], at // buckets
        if scaled:
            total = total / np.sqrt(np.bincount(row, total * total, n))[row]
        out.append((at % buckets, total))
        sizes[a : a + n] = np.bincount(row, minlength=n)
    idx, val = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in (0, 1))
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((idx.astype(np.int32), pa.int32()), (val.astype(np.float64), pa.float64()))]
    return pa.RecordBatch.from_arrays([case, *lists], ["case_id", "idx", "val"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each value of an array column, and the values."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


SPARSE = "case_id long, idx array<int>, val array<double>"


def _signed(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signs of hashes, as ``bucket_of`` and ``sign_of`` have them."""
    return np.mod(codes, buckets), np.where((codes >> 62) & 1 == 0, 1.0, -1.0)


def _together(parts: DataFrame, buckets: int) -> DataFrame:
    """Rows of the same case added up and scaled: one pair of arrays per row is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, idx = _lists(batch.column("idx"))
            yield _summed(batch.column("case_id"), rows, idx, _lists(batch.column("val"))[1], buckets, True)

    rows = parts.groupBy("case_id").agg(F.collect_list(F.struct("idx", "val")).alias("p")).select("case_id", F.flatten("p.idx").alias("idx"), F.flatten("p.val").alias("val"))
    return rows.mapInArrow(run, SPARSE)


def hashed_rows(texts: DataFrame, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """``case_id, idx, val``: ``sparse_rows(hashed_features(...))`` of rows ``case_id, grams`` (arrays).

    The grams of a row are hashed and counted within it, so what is shuffled is one pair of arrays per row, for cases of several rows.
    """

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes = _lists(batch.column("h"))
            yield _summed(batch.column("case_id"), rows, *_signed(codes.astype(np.int64), buckets), buckets, False)

    hashes = F.transform("grams", lambda g: F.xxhash64(F.lit(seed), g))
    return _together(texts.select(F.col("case_id").cast("long").alias("case_id"), hashes.alias("h")).mapInArrow(own, SPARSE), buckets)


def hashed_texts(texts: DataFrame, buckets: int = BUCKETS, seed: int = 3) -> DataFrame:
    """``hashed_rows`` of rows ``case_id, text``, with the grams ``T.word_ngrams(T.folded_words(text))`` taken and hashed in one pass over arrays of bytes: no gram is a string of its own.

    A worker holds ROWS texts, or as many as have CHARACTERS characters, at a time.
    """

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(case: pa.Array) -> pa.RecordBatch:
            codes, rows = gram_hashes(held, seed)
            return _summed(case, rows, *_signed(codes, buckets), buckets, False)

        for batch in batches:
            case, held, first, size = batch.column("case_id"), [], 0, 0
            for k, text in enumerate(batch.column("text")):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= CHARACTERS or len(held) == ROWS:
                    yield summed(case.slice(first, len(held)))
                    held, first, size = [], k + 1, 0
            if held:
                yield summed(case.slice(first, len(held)))

    return _together(texts.select(F.col("case_id").cast("long").alias("case_id"), "text").mapInArrow(own, SPARSE), buckets)


def sparse_rows(features: DataFrame) -> DataFrame:
    """``case_id, idx, val``: one row per case with parallel arrays."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "value")))
    return features.groupBy("case_id").agg(F.transform(pairs, lambda p: p["bucket"]).alias("idx"), F.transform(pairs, lambda p: p["value"]).alias("val"))


def vectors(hashed: DataFrame, slots: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``case_id, idx, val``: the hashed features of a case, then its numeric slots (``numeric_table``) behind the buckets."""
    return with_slots(sparse_rows(hashed), slots, buckets)


def with_slots(rows: DataFrame, slots: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The same from rows ``case_id, idx, val``."""
    names = [c for c in slots.columns if c != "case_id"]
    numbers = slots.select("case_id", F.array(*names).alias("numbers"))
    joined = numbers.join(rows, "case_id", "left")
    places = F.array(*[F.lit(buckets + k) for k in range(len(names))])
    return joined.select("case_id", F.concat(F.coalesce("idx", F.array().cast("array<int>")), places).alias("idx"), F.concat(F.coalesce("val", F.array().cast("array<double>")), "numbers").alias("val"))


#: Outputs of a model: risk, the dimensions, the categories.
CATEGORY_NAMES = (*(c[0] for c in config.CATEGORIES), "suspicious_other", "no_violation")
HEADS = ("risk", *config.DIMENSIONS, *CATEGORY_NAMES)
DIMS = slice(1, 1 + len(config.DIMENSIONS))
CATS = slice(1 + len(config.DIMENSIONS), len(HEADS))


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows of a batch of (idx, val) as a matrix with a column of ones at its end."""
    x = np.zeros((batch.num_rows, width + 1), np.float32)
    rows, idx = _lists(batch.column("idx"))
    x[rows, idx] = _lists(batch.column("val"))[1]
    x[:, -1] = 1
    return x


#: Rows as they are stored for training: arrays as bytes, which are copied and not taken apart on their way to a task.
STORED = "row long, idx binary, val binary, y binary, w double, number int"
STORED_AS = {"idx": np.int32, "val": np.float32, "y": np.float64}


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for c, kind in STORED_AS.items():
            lists = columns[c]
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32) * np.int32(np.dtype(kind).itemsize)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), kind)
            columns[c] = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.append(np.int32(0), ends)), pa.py_buffer(values)])
        yield pa.RecordBatch.from_pydict(columns)


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many of them each row has."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data else np.zeros(0, kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def _block(parts: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as a matrix with a column of ones at its end, their targets, weights and numbers."""
    whole = lambda c: pa.concat_arrays([p.column(c) for p in parts])
    w, row = whole("w").to_numpy(), whole("row").to_numpy()
    (idx, sizes), (val, _), (y, _) = (_unpacked(whole(c), kind) for c, kind in STORED_AS.items())
    x = np.zeros((len(w), width + 1), np.float32)
    x.ravel()[np.repeat(np.arange(0, x.size, width + 1), sizes) + idx] = val
    x[:, -1] = 1
    return x, y.reshape(len(w), -1), w, row


def _blocks(batches: Iterable[pa.RecordBatch], width: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``rows`` rows, the last one of what is left, wherever the batches end."""
    parts, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            parts.append(batch.slice(at, rows - size))
            at, size = at + parts[-1].num_rows, size + parts[-1].num_rows
            if size == rows:
                yield _block(parts, width)
                parts, size = [], 0
    if size:
        yield _block(parts, width)


def shares(z: np.ndarray) -> np.ndarray:
    """Probabilities of all heads from their logits: risk and dimensions by themselves, categories together."""
    z = np.clip(z, -30, 30)
    out = 1 / (1 + np.exp(-z))
    e = np.exp(z[:, CATS] - z[:, CATS].max(1, keepdims=True))
    out[:, CATS] = e / e.sum(1, keepdims=True)
    return out


def _forward(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return shares(x @ weights)


def _gap(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the logits: risk + 1/2 mean of the dimensions + 1/2 of the categories, rows by weight."""
    g = (p - y) * w[:, None]
    g[:, DIMS] *= 0.5 / len(config.DIMENSIONS)
    g[:, CATS] *= 0.5
    return g


def _loss(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    q = np.clip(p, 1e-7, 1 - 1e-7)
    bce = -(y * np.log(q) + (1 - y) * np.log(1 - q))
    return float((w * (bce[:, 0] + 0.5 * bce[:, DIMS].mean(1) - 0.5 * (y[:, CATS] * np.log(q[:, CATS])).sum(1))).sum())


@dataclass
class HeadModel:
    """Weights (features and bias x heads) and what training has seen: (epoch, loss on held rows)."""

    weights: np.ndarray
    history: list[tuple[int, float]]
    temperature: float = 1.0

    @property
    def best_epoch(self) -> int:
        return min(self.history, key=lambda h: (h[1], h[0]))[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of rows with a one in the last column."""
        return _forward(x, self.weights)

    def risk_gradient(self, x: np.ndarray) -> np.ndarray:
        """Derivative of the risk logit by each input, per row."""
        return np.broadcast_to(self.weights[:-1, 0], (len(x), len(self.weights) - 1))


def targets(labels: DataFrame) -> DataFrame:
    """``case_id, y, w``: one array of all heads' targets per labelled row; a missing category spreads evenly, a missing weight is 1."""
    category = F.array(*[F.when(F.col("category").isin(*CATEGORY_NAMES), (F.col("category") == c).cast("double")).otherwise(1.0 / len(CATEGORY_NAMES)) for c in CATEGORY_NAMES])
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    return labels.select("case_id", F.concat(F.array(share("risk"), *map(share, config.DIMENSIONS)), category).alias("y"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w"))


def train_heads(rows: DataFrame, width: int, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, l2: float = 1e-4, parts: int | None = None, seed: int = 11) -> HeadModel:
    """The baseline, a linear model of all heads from ``case_id, idx, val, y, w, held``: data-parallel Adam with averaging.

    Every epoch each of ``parts`` partitions (from the number of rows: 64 of a partition at least, and not more than cores) goes once over its rows in mini-batches, starting from the shared weights, and gives back its weights and the
    loss of those shared weights on its held rows; weights are averaged by numbers of rows.  What travels is the model, ``parts`` times; rows stay
    where they are, in an order that a hash fixes.  The weights with the least loss on held rows win.
    """
    spark = rows.sparkSession
    parts = parts or max(1, min(spark.sparkContext.defaultParallelism, rows.count() // 64))
    dealt = rows.repartition(parts, F.xxhash64(F.lit(seed), "case_id")).sortWithinPartitions(F.xxhash64(F.lit(seed + 1), "case_id"), "case_id")
    # Where the network has a row's number stands whether it is held.
    placed = materialise(dealt.select(F.coalesce("held", F.lit(False)).cast("long").alias("row"), "idx", "val", "y", "w", F.lit(0).alias("number")).mapInArrow(_packed, STORED))
    weights, history, best = np.zeros((width + 1, len(HEADS)), np.float32), [], None

    def epoch(batches: Iterable[pa.RecordBatch], shared, learn: bool) -> Iterator[pa.RecordBatch]:
        w = shared.value.copy()
        first, second, step = np.zeros_like(w), np.zeros_like(w), 0
        n, loss, held = 0, 0.0, 0.0
        for x, y, own, out in _blocks(batches, width, batch):
            kept = out != 0
            if kept.any():
                loss += _loss(_forward(x[kept], shared.value), y[kept], own[kept])
                held += own[kept].sum()
            if learn and not kept.all():
                x, y, own = (z[~kept] for z in (x, y, own))
                grad = x.T @ _gap(_forward(x, w), y, own).astype(np.float32) / np.float32(max(own.sum(), 1e-9)) + np.float32(l2) * w
                step += 1
                first += np.float32(0.1) * (grad - first)
                second += np.float32(0.001) * (grad * grad - second)
                w -= np.float32(rate / (1 - 0.9**step)) * first / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
                n += len(own)
        yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "held": [float(held)], "w": [w.tobytes() if n else b""]})

    for k in range(epochs + 1):
        shared = spark.sparkContext.broadcast(weights)
        with small_batches(spark), whole_files(spark):
            found = placed.mapInArrow(lambda batches, s=shared, last=k == epochs: epoch(batches, s, not last), "n long, loss double, held double, w binary").collect()
        history.append((k, sum(r["loss"] for r in found) / max(sum(r["held"] for r in found), 1e-9)))
        if best is None or history[-1][1] < best[0]:
            best = (history[-1][1], weights)
        total = sum(r["n"] for r in found)
        if total:
            weights = sum(np.frombuffer(r["w"], np.float32).reshape(weights.shape) * np.float32(r["n"] / total) for r in found if r["n"])
        shared.unpersist()
    drop(placed)
    return HeadModel(best[1], history)


PREDICTION = "case_id long, prob double, " + ", ".join(f"{d} int" for d in config.DIMENSIONS) + ", category string, confidence double"


def predict(rows: DataFrame, model: object, width: int) -> DataFrame:
    """``case_id, prob, score, level``, the dimensions (0 to 100), ``category, confidence, uncertain`` per row of ``case_id, idx, val``.

    ``model``: what has ``probabilities`` and a ``temperature``, such as the linear heads or the network.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                p = m.probabilities(_dense(part, width))
                q = np.clip(p[:, 0], 1e-6, 1 - 1e-6)
                prob = 1 / (1 + np.exp(-np.log(q / (1 - q)) / m.temperature))
                dims = np.rint(100 * p[:, DIMS]).astype(np.int32)
                best = p[:, CATS].argmax(1)
                columns = {"case_id": part.column("case_id"), "prob": prob.astype(float)} | {d: dims[:, k] for k, d in enumerate(config.DIMENSIONS)} | {"category": [CATEGORY_NAMES[k] for k in best], "confidence": p[:, CATS].max(1).astype(float)}
                yield pa.RecordBatch.from_pydict({c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in columns.items()})

    found = rows.select(F.col("case_id").cast("long").alias("case_id"), "idx", "val").mapInArrow(run, PREDICTION)
    score = clamp(100 * F.col("prob"))
    return found.withColumns({"score": score, "level": risk_level(score), "uncertain": F.col("prob").between(*config.UNCERTAIN)})


def with_fallback(scores: DataFrame, predictions: DataFrame, mode: str = "blend") -> DataFrame:
    """Rule scores (``case_id, score`` and the dimensions) blended with predictions, dimension by dimension; without a prediction the rules stay."""
    guess = predictions.select("case_id", F.col("score").alias("__score"), *[F.col(d).alias(f"__{d}") for d in config.DIMENSIONS])
    joined = scores.join(guess, "case_id", "left")
    return joined.select("case_id", *[blend(F.col(c).cast("int"), F.col(f"__{c}"), mode).alias(c) for c in ("score", *config.DIMENSIONS)], F.col("__score").isNull().alias("rules_only"))


def soft_targets(predictions: DataFrame) -> DataFrame:
    """Labels for a smaller model from the predictions of a larger one: its probabilities as targets, its confidence as weight."""
    return predictions.select("case_id", F.col("prob").alias("risk"), (F.col("prob") >= 0.5).alias("is_scam"), F.greatest(F.lit(0.2), F.col("confidence")).alias("weight"), "category", *[(F.col(d) / 100).alias(d) for d in config.DIMENSIONS])


def bucket_of(gram: Column, buckets: int = BUCKETS, seed: int = 3) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), gram), F.lit(buckets)).cast("int")


def sign_of(gram: Column, seed: int = 3) -> Column:
    """The sign with which a gram counts in its bucket."""
    return F.when(F.shiftright(F.xxhash64(F.lit(seed), gram), 62) % 2 == 0, 1.0).otherwise(-1.0)


def sampling_plan(strata: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``key, n, quota, share``: rows of each stratum, how many a balanced sample takes (alike for all, no more than there are), and that as a share.

    ``strata`` has a row per row of the data; without ``total`` every stratum gives as many as the smallest one.
    """
    counts = strata.groupBy(key).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over one row per stratum
    even = F.min("n").over(every) if total is None else F.floor(F.lit(total) / F.count("*").over(every))
    return counts.withColumn("quota", F.least("n", even)).withColumn("share", F.col("quota") / F.col("n"))


def balanced_sample(df: DataFrame, key: str, stratum: str, plan: DataFrame, seed: int = 29) -> DataFrame:
    """Rows by a hash of their key under their stratum's share: about the quota of each, without ordering any stratum."""
    shares = plan.select(F.col(stratum).alias("__s"), F.col("share").alias("__share"))
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    return df.join(shares, df[stratum].eqNullSafe(shares["__s"])).where(u < F.col("__share")).select(*df.columns)


def pooled(blocks: Iterable[tuple[float, float, float]]) -> list[list[float]]:
    """Adjacent violators pooled: blocks (first score, sum of y, weight) in order of score become blocks with rising means."""
    out: list[list[float]] = []
    for first, total, weight in blocks:
        out.append([first, total, weight])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            _, total, weight = out.pop()
            out[-1][1] += total
            out[-1][2] += weight
    return out


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    found = pooled(frame.sort_values("p")[["p", "y", "w"]].itertuples(index=False, name=None))
    return pd.DataFrame({"at": [frame["at"].iloc[0]] * len(found), "p": [b[0] for b in found], "y": [b[1] for b in found], "w": [b[2] for b in found]})


def isotonic_blocks(points: DataFrame, fan: int = 8) -> DataFrame:
    """``p, mean``: the blocks of the isotonic regression, by their smallest score, from points ``p, y`` (sum) ``, w`` (count).

    Points lie in ranges of about equal numbers.  Each range is pooled by itself, then ``fan`` neighbouring ranges together, and so on up: pooling is
    the same whatever is pooled first, and a pooled block stands for all its points.  Labels of 0 and 1 have at most some n^(2/3) blocks.
    """
    table = ranged(points, "p")
    cells = (table.agg(F.max("__cell")).first()[0] or 0) + 1
    level = table.select(F.col("__cell").alias("at"), "p", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    while True:
        level = materialise(level.groupBy("at").applyInPandas(_pool, "at int, p double, y double, w double"))
        if cells == 1:
            return level.select("p", (F.col("y") / F.col("w")).alias("mean"))
        cells = -(-cells // fan)
        level = level.withColumn("at", F.floor(F.col("at") / fan).cast("int"))


def isotonic(df: DataFrame, p: str, y: str = "y") -> DataFrame:
    """``df`` with ``calibrated``: isotonic regression of ``y`` on ``p``; null scores stay null.

    A score's block is the last one that begins at or below it: blocks and points lie in ranges together, each range is read in order, and what is open at the
    end of a range goes on in the next ones.  Nothing passes the driver but the number of ranges.
    """
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    blocks = isotonic_blocks(points)
    scores = df.select(F.col(p).cast("double").alias("p")).where("p is not null").distinct()
    both = ranged(blocks.select("p", "mean").unionByName(scores.select("p", F.lit(None).cast("double").alias("mean"))), "p")
    last = both.where("mean is not null").groupBy("__cell").agg(F.max_by("mean", "p").alias("open"))
    cells = both.select("__cell").distinct().join(last, "__cell", "left")  # one row per range
    carried = cells.select("__cell", F.last("open", ignorenulls=True).over(Window.partitionBy().orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    inside = F.last("mean", ignorenulls=True).over(Window.partitionBy("__cell").orderBy("p", F.col("mean").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("__inside", inside).where("mean is null").join(carried, "__cell").select(F.col("p").alias("__p"), F.coalesce("__inside", "open").alias("calibrated"))
    return df.join(placed, df[p].cast("double") == placed["__p"], "left").drop("__p")


def tempered(p: Column, temperature: float | Column) -> Column:
    """sigmoid(logit(p) / T), with p held 1e-6 away from 0 and 1."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / temperature))


#: The interval of temperatures.
COLDEST, HOTTEST = 0.25, 10.0


def temperature_grid(low: float, high: float, points: int) -> list[float]:
    return [low + (high - low) * k / (points + 1) for k in range(points + 2)]


def fit_temperature(df: DataFrame, p: str, y: str = "y", points: int = 16, tolerance: float = 1e-7) -> DataFrame:
    """``temperature, nll`` of least log loss between 0.25 and 10, as one row; 1.0 without a row or with one class only.

    The loss has one minimum, so each pass of ``points`` temperatures between the ends of the bracket leaves the two next to the best of them (a golden section with many
    points a pass): about nine passes to 1e-7.  A pass is one aggregate over distinct scores with counts.
    """
    spark = df.sparkSession
    rows = materialise(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(F.when(F.col(y) >= 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) >= 0.5, 0).otherwise(1)).alias("neg")))
    total = rows.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()

    def losses(at: list[float]) -> list[float]:
        def loss(t: float) -> Column:
            q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), tempered(F.col("p"), t)))
            return F.sum(-F.col("pos") * F.log(q) - F.col("neg") * F.log(1 - q))

        found = rows.agg(*[loss(t).alias(f"l{k}") for k, t in enumerate(at)]).first()
        return [x / ((total["pos"] or 0) + (total["neg"] or 0)) for x in found]

    best, nll = 1.0, None
    if total["pos"] and total["neg"]:
        low, high = COLDEST, HOTTEST
        while high - low > tolerance:
            grid = temperature_grid(low, high, points)
            found = losses(grid)
            k = min(range(len(grid)), key=found.__getitem__)
            low, high = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
        best = (low + high) / 2
    if total["pos"] or total["neg"]:
        nll = losses([best])[0]
    drop(rows)
    return spark.createDataFrame([(best, nll)], "temperature double, nll double")
