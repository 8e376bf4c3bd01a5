"""Language identification in two steps: the family first, then linear one-versus-one machines within it.

Features are hashed byte pairs and triples of the whole text (A-Z lowered, digits and
punctuation read as one mark), as square roots of their shares.  Linear support vector machines are fitted on a
bounded sample (at most SAMPLE documents, shared evenly by the languages), chosen by a hash of the id;
features are counted on the executors and only counts of the sample reach the driver.  The fitted weights
(families x features plus pairs x features) go out with the task, and every document is scored where it lies: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import documents, remainder, slices, text_buffer

#: Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sr", "hr", "sl"),
    "turkic": ("tr", "kk", "az", "uz", "ky", "tt"),
}
BINS = 1 << 12
SAMPLE = 1500
UNKNOWN = "und"
#: Bytes are read as one of these classes: letters (and bytes of longer characters) for themselves, a space, a mark.
CLASS = np.full(256, 1, np.uint32)
CLASS[[32, *range(9, 14)]] = 0
CLASS[97:123] = np.arange(97, 123)
CLASS[65:91] = CLASS[97:123]
CLASS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte pairs and triples per row, BINS columns."""
    base = int(offsets[0])
    c = CLASS[data[base : int(offsets[-1])]]
    c = np.concatenate([c, np.zeros(2, np.uint32)])
    pairs = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)) >> np.uint32(20)
    triples = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) >> np.uint32(20)
    out = np.empty((len(offsets) - 1, BINS), np.float32)
    for k, (a, b) in enumerate(zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True)):
        # A pair or triple that would reach into the next row is left out.
        out[k] = np.bincount(pairs[a : max(a, b - 1)], minlength=BINS) + np.bincount(triples[a : max(a, b - 2)], minlength=BINS)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1."""
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, classes weighing alike; y is -1 or 1. Accelerated descent."""
    # The last column of x is the bias.
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, pace = w, x.dtype.type(1 / (2 * 2.0 + 2 * penalty))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - pace * (2 * penalty * ahead - 2 * (x.T @ (share * y * slack)))
        ahead, w = step + x.dtype.type(k / (k + 3)) * (step - w), step
    return w


class Model:
    """Families one against the rest, then pairs of languages within each family."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        x, lang = np.ones((len(counts), BINS + 1), np.float32), np.array(langs)
        # In place, since the driver's memory is small.
        np.divide(counts, np.maximum(counts.sum(1, keepdims=True), 1), out=x[:, :-1])
        np.sqrt(x[:, :-1], out=x[:, :-1])
        family = np.array([family_of(v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: sorted(set(lang[family == f])) for f in self.families}
        sign = lambda mask: np.where(mask, 1, -1).astype(np.float32)
        self.first = np.array([fit_svm(x, sign(family == f)) for f in self.families]) if len(self.families) > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.pairs = {}
        for langs_of in self.members.values():
            for a, b in combinations(langs_of, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], sign(lang[rows] == a))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) per row."""
        x = scaled(counts)
        squash = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -9, 9)))
        margin = x @ self.first[:, :-1].T + self.first[:, -1]
        best = margin.argmax(1)
        odds = squash(margin)
        score = (odds.max(1) / odds.sum(1)) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            strength = np.zeros_like(votes)
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                p = squash(x[rows] @ self.pairs[a, b][:-1] + self.pairs[a, b][-1])
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                strength[:, i] += p
                strength[:, j] += 1 - p
            order = votes + strength / (len(members) + 1)  # ties of votes go to the larger sum of scores
            pick = order.argmax(1)
            out[rows] = np.array(members, object)[pick]
            if len(members) > 1:
                score[rows] *= strength[np.arange(len(rows)), pick] / (len(members) - 1)
        return out.tolist(), score


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        rows = [row.astype("<u4").tobytes() for a, b in slices(offsets) for row in features(data, offsets[a : b + 1])]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "counts"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on rows where ``learn`` holds and language and text are there; None without any such row.

    ``sample``: about so many documents are fitted on, shared evenly by the languages, at least one each; so at most that many languages, the
    most frequent ones (ties by name), can be learned.  Texts of the sample are read whole.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    spread = F.pmod(F.xxhash64(F.lit(41), id_col), F.lit(1 << 40)) / float(1 << 40)
    # One row per language, at most ``sample``.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in sizes], "__lang string, __share double")
    known = docs.where(learn).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), spread.alias("at"))
    taken = known.join(F.broadcast(shares), F.col("lang") == F.col("__lang")).where("at < __share and text != ''").select("lang", "text")
    table = taken.mapInArrow(_counted, "lang string, counts binary").toArrow()
    if not table.num_rows:
        return None
    # In a fixed order, so that reruns give the same weights.
    table = table.sort_by([("lang", "ascending"), ("counts", "ascending")]).combine_chunks()
    counts = np.frombuffer(b"".join(c.as_py() for c in table["counts"]), "<u4").reshape(table.num_rows, BINS)
    return Model(counts, table["lang"].to_pylist())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row; ``und`` and 0 for a null text, a text without letters, or without a model.

    Repeated rows are predicted each; ties of votes go to the larger sum of scores, then to the first language by name. A long text is one row of
    counts, whatever its length. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_buffer(column)
            langs, scores = [], []
            for a, b in slices(offsets):
                known = np.array([has_letter(t.as_py()) for t in column[a:b]], bool)
                if model is None or not known.any():
                    got, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    got, score = model.predict(features(data, offsets[a : b + 1]))
                langs += [g if k else UNKNOWN for g, k in zip(got, known, strict=True)]
                scores.append(np.where(known, score, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def learning(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 3) != 1


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns; where ``lang_col`` is null it takes the predicted language.

    A row goes if it is predicted ``und``.  The prediction rides along with the row through one pass, so nothing is joined or shuffled.
    """
    model = fit(docs, learning(id_col), id_col, text_col, lang_col)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lang = names.index(text_col), names.index(lang_col)
        for batch in batches:
            column = batch.column(at)
            data, offsets = text_buffer(column)
            found = []
            for a, b in slices(offsets):
                known = [has_letter(t.as_py()) for t in column[a:b]]
                got = model.predict(features(data, offsets[a : b + 1]))[0] if model is not None else [None] * len(known)
                found += [g if k else UNKNOWN for k, g in zip(known, got, strict=True)]
            found = pa.array(found, pa.string())
            filled = batch.set_column(lang, batch.schema.field(lang), pc.coalesce(batch.column(lang), found.cast(batch.column(lang).type)))
            yield filled.filter(pc.fill_null(pc.not_equal(found, UNKNOWN), True))

    return docs.mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, learning())
    return predict(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
