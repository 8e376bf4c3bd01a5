"""Toxic spans by a linear-chain conditional random field over tokens, aggregated to document scores.

Labels are given per document, so tokens are labelled first: a word or word stem marks a token of a toxic document
when documents with it are toxic far more often than chance allows (log-likelihood ratio).  On these
labelled tokens a two-tag chain is fitted (hashed word, stem and shape features; transitions).  Forward-backward marginals give
each token's probability; a document's score comes from its strongest tokens and their expected number, and runs of
tokens above one half are the offending spans.

Fitting uses a bounded sample: about TOXIC and CLEAN documents by a hash of the id, of at most LONGEST bytes each; of near copies among them one; and of
their sentences without a toxic token as many as come to CLEAN_TOKENS tokens or CLEAN_TIMES as many tokens as the others have.  Features are made
on the executors and the sample's hashed tokens reach the driver.  All four are arguments of ``fit``.
Scoring reads every text whole, in place: no shuffle.  A chain is a sentence, however long: messages run through it from end to end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.common import BYTE, ROOT, documents, mix, powers, remainder, slices, text_buffer

TOXIC, CLEAN = 1500, 3000
LONGEST, CLEAN_TOKENS, CLEAN_TIMES = 1 << 17, 20_000, 4
BINS = 1 << 18
#: While at least so many chains are as long, their tokens are worked on together, place by place; the ends of the few longest ones token by token.
TOGETHER = 12
#: Feature templates: the whole word, then stems of so many bytes.
STEMS = (4, 5, 6)
#: Tokens of the sample that the driver works on at once: with all of them, each intermediate array would have the size of the sample.
AT_ONCE = 1 << 16
THRESHOLD = 0.3
#: A mark's documents are toxic at least so many times as often as clean ones.
LIFT = 5.0

#: Word bytes: letters, digits, apostrophes inside do not count; bytes of longer characters do.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


class Tokens:
    """Tokens of some rows: features, sentence, place in the sentence, byte spans."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        data, row = data[base : int(offsets[-1])], offsets - base
        word = WORD[data]
        first = np.zeros(len(data) + 1, bool)
        first[row] = True
        fresh, ends = word.copy(), word.copy()
        fresh[1:] &= ~word[:-1] | first[1:-1]
        ends[:-1] &= ~word[1:] | first[1:-1]
        self.starts = np.flatnonzero(fresh)
        self.ends = np.flatnonzero(ends) + 1
        self.counts = np.diff(np.searchsorted(self.starts, row))
        n = len(self.starts)
        self.doc = np.repeat(np.arange(len(row) - 1), self.counts)
        self.features = np.zeros((n, 1 + len(STEMS)), np.int32)
        self.chain = self.place = np.zeros(0, np.int64)
        if not n:
            return
        lengths = self.ends - self.starts
        where = np.repeat(self.starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        at = where - np.repeat(self.starts, lengths)
        value = BYTE[data[where]] * powers(ROOT, int(lengths.max()) + 1)[at]
        edges = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for k, stem in enumerate((None, *STEMS)):
            # A stem is used only where the word is longer, so that it is not the word again.
            h = np.add.reduceat(value if stem is None else np.where(at < stem, value, np.uint64(0)), edges)
            self.features[:, k] = (mix(h + np.uint64(k)) & np.uint64(BINS - 1)).astype(np.int32)
            if stem is not None:
                self.features[lengths <= stem, k] = self.features[lengths <= stem, 0]
        stops = np.cumsum(STOP[data])
        sentence = stops[self.starts] + np.searchsorted(row, self.starts, "right") * (stops[-1] + 1)
        new = np.concatenate([[True], sentence[1:] != sentence[:-1]])
        heads = np.flatnonzero(new)
        self.chain = np.cumsum(new) - 1
        self.place = np.arange(n) - np.repeat(heads, np.diff(heads, append=n))


def marginals(emission: np.ndarray, move: np.ndarray, chain: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of tag 1 per token, expected transitions (2 x 2) and the log partition sum, by forward-backward over all chains at once.

    ``emission``: score of tag 1 over tag 0; ``move``: transition scores.  With two tags, the ratio of the
    forward (backward) values of tag 1 and 0 is all there is to carry.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(move)
    heads = np.flatnonzero(place == 0)  # a chain's tokens lie one after the other
    lengths = np.diff(heads, append=n)
    # Chains are longer than ``shared`` in fewer than TOGETHER cases.
    shared = max(1, int(np.sort(lengths)[max(0, len(lengths) - TOGETHER)]))
    tails = [(s, int(heads[s]), int(heads[s] + lengths[s])) for s in np.flatnonzero(lengths > shared).tolist()]
    levels = [(s, heads[s] + k) for k in range(shared) for s in [np.flatnonzero(lengths > k)]]
    ahead, back = np.ones(n), np.ones(n)
    log_z, ratio = np.zeros(len(heads)), np.zeros(len(heads))
    (m00, m01), (m10, m11) = m.tolist()
    for k, (s, level) in enumerate(levels):
        if k == 0:
            new = e[level]
        else:
            r = ratio[s]
            zero, one = m00 + r * m10, m01 + r * m11
            log_z[s] += np.log(zero)
            new = e[level] * one / zero
        ratio[s] = np.clip(new, 1e-30, 1e30)
        ahead[level] = ratio[s]
    for s, head, end in tails:
        r, z, out = float(ratio[s]), 0.0, []
        for x in e[head + shared : end].tolist():
            zero = m00 + r * m10
            z += math.log(zero)
            r = min(max(x * (m01 + r * m11) / zero, 1e-30), 1e30)
            out.append(r)
        ratio[s], ahead[head + shared : end] = r, out
        log_z[s] += z
    log_z += np.log1p(ratio)
    later = np.ones(len(heads))
    for s, head, end in tails:
        b, out = 1.0, []
        for x in e[head + shared : end][::-1].tolist():
            out.append(b)
            q = x * b
            b = min(max((m10 + m11 * q) / (m00 + m01 * q), 1e-30), 1e30)
        later[s], back[head + shared : end] = b, out[::-1]
    for k in range(shared - 1, -1, -1):
        s, level = levels[k]
        back[level] = later[s]
        if k:
            q = e[level] * back[level]
            later[s] = np.clip((m10 + m11 * q) / (m00 + m01 * q), 1e-30, 1e30)
    # Expected transitions, from the messages on both sides of each.
    follow = np.flatnonzero(place > 0)
    q, before = e[follow] * back[follow], ahead[follow - 1]
    joint = np.stack([np.full(len(follow), m00), m01 * q, before * m10, before * m11 * q])
    pairs = (joint / joint.sum(0)).sum(1).reshape(2, 2)
    odds = ahead * back
    return odds / (1 + odds), pairs, float(log_z.sum())


class Model:
    """Weights of the chain and of the document score."""

    def __init__(self):
        self.weights = np.zeros(BINS, np.float32)
        self.bias, self.move = -6.0, np.zeros((2, 2))
        self.center, self.spread, self.top = np.zeros(4), np.ones(4), np.array([-3.0, 0.0, 0.0, 0.0, 0.0])

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1) + self.bias

    def tokens(self, t: Tokens) -> np.ndarray:
        return marginals(self.emission(t.features), self.move, t.chain, t.place)[0]

    @staticmethod
    def summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per document: strongest token, expected number of toxic tokens (10 at most) and its log, their share."""
        most, count = np.zeros(n), np.bincount(doc, minlength=n)
        np.maximum.at(most, doc, p)
        expected = np.bincount(doc, p, minlength=n)
        return np.stack([most, np.minimum(expected, 10.0), np.log1p(expected), expected / np.maximum(count, 1)], 1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        z = (summary - self.center) / self.spread
        return 1 / (1 + np.exp(-np.clip(z @ self.top[1:] + self.top[0], -30, 30)))


def whole_documents(doc: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of the tokens of whole documents, of about ``most`` tokens (one document at least); ``doc`` rises."""
    a = 0
    while a < len(doc):
        b = int(np.searchsorted(doc, doc[min(a + most, len(doc)) - 1], "right"))
        yield slice(a, b)
        a = b


def token_tags(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tags from document labels: 1 for a token of a toxic document with a feature that marks toxic documents; ``doc`` rises."""
    n_tox, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    a, b = np.zeros(BINS), np.zeros(BINS)
    for part in whole_documents(doc):
        key = np.unique(np.concatenate([doc[part].astype(np.int64) * BINS + features[part, k] for k in range(features.shape[1])]))
        d, f = key // BINS, key % BINS
        a += np.bincount(f[toxic[d]], minlength=BINS)
        b += np.bincount(f[~toxic[d]], minlength=BINS)
    total, share = a + b, n_tox / (n_tox + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (total * share)), 0) + np.where(b > 0, b * np.log(b / (total * (1 - share))), 0))
        lift = (a + 0.1) / n_tox / ((b + 0.1) / n_clean)
    marks = (g > 2 * np.log(max(2, int((total > 0).sum())))) & (lift > LIFT)
    tags = toxic[doc]
    for part in whole_documents(doc):
        tags[part] &= marks[features[part]].any(1)
    return tags


def fit_chain(model: Model, features: np.ndarray, chain: np.ndarray, place: np.ndarray, tags: np.ndarray, steps: int = 60) -> None:
    """Gradient ascent (Adam) on the chains' conditional likelihood; only features that occur here get a weight."""
    used, local = np.unique(features, return_inverse=True)
    local = local.reshape(features.shape)
    w, bias, move = np.zeros(len(used)), -3.0, np.zeros((2, 2))
    first, second = np.zeros(len(used) + 5), np.zeros(len(used) + 5)
    tag = tags.astype(float)
    follow = np.flatnonzero(place > 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[follow - 1].astype(int), tags[follow].astype(int)), 1)
    # Toxic tokens are few; both tags weigh in through the sum, so no token is left out.
    scale = max(1.0, float(tags.sum()))
    for k in range(1, steps + 1):
        p, pairs, _ = marginals(w[local].sum(1) + bias, move, chain, place)
        gap = tag - p
        grad = np.bincount(local.ravel(), np.repeat(gap, features.shape[1]), minlength=len(used)) / scale * 20 - 0.01 * w
        grad = np.concatenate([grad, [gap.sum() / scale], ((seen - pairs) / scale).ravel() - 0.01 * move.ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
        w += step[: len(used)]
        bias += step[len(used)]
        move += step[len(used) + 1 :].reshape(2, 2)
    model.weights[used] = w
    model.bias, model.move = float(bias), move


def fit_top(model: Model, x: np.ndarray, toxic: np.ndarray, prior: float, steps: int = 800) -> None:
    """Logistic regression from a document's summary to its label; the sample is weighed so that ``prior`` is the share of toxic documents."""
    model.center, model.spread = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - model.center) / model.spread])
    share = np.where(toxic, prior / max(1, toxic.sum()), (1 - prior) / max(1, (~toxic).sum()))
    w = np.zeros(1 + x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += 1.0 * (z.T @ (share * (toxic - p)) - 0.001 * np.array([0, *w[1:]]))
    model.top = w


def _tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out = {"features": [], "place": []}
        for a, b in slices(offsets):
            t = Tokens(data, offsets[a : b + 1])
            edges = np.concatenate([[0], np.cumsum(t.counts)])
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                out["features"].append(t.features[x:y].tobytes())
                out["place"].append(t.place[x:y].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(v, pa.binary()) for v in out.values())], ["toxic", *out])


def distinct_enough(table: list[dict]) -> list[dict]:
    """Leave out copies and near copies within the sample (equal bottom-3 sketches of the words): they would make their rare words look telling."""
    seen, out = set(), []
    for r in table:
        words = np.unique(np.frombuffer(r["features"], np.int32).reshape(-1, 1 + len(STEMS))[:, 0])
        sketch = np.sort(mix(words.astype(np.uint64)))[:3].tobytes()
        if (r["toxic"], sketch) not in seen or len(words) < 3:
            seen.add((r["toxic"], sketch))
            out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most_toxic: int = TOXIC, most_clean: int = CLEAN, longest: int = LONGEST, clean_tokens: int = CLEAN_TOKENS, clean_times: float = CLEAN_TIMES) -> Model:
    """Fit on ``docs(doc_id, text)`` joined with ``labels(doc_id, toxic)`` where ``learn`` holds; without toxic or without clean rows the model says no.

    The sample is bounded in documents and in bytes (see the head of the module), so what reaches the driver does not grow with the tables; the
    share of toxic documents is counted over all labels.
    """
    model = Model()
    labels = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return model
    spread = F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, min(1.0, most_toxic / size[1])).otherwise(min(1.0, most_clean / size[0]))
    # At most about most_toxic + most_clean ids of 12 bytes: the bound on what is broadcast.
    chosen = labels.where(spread < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    table = rows.select("toxic", "text").mapInArrow(_tokenised, "toxic int, features binary, place binary").toArrow().to_pylist()
    table.sort(key=lambda r: (r["toxic"], r["features"]))
    table = distinct_enough(table)
    lengths = [len(r["place"]) // 4 for r in table]
    features = np.frombuffer(b"".join(r["features"] for r in table), np.int32).reshape(-1, 1 + len(STEMS))
    place = np.frombuffer(b"".join(r["place"] for r in table), np.int32)
    toxic = np.array([r["toxic"] == 1 for r in table])
    n = len(table)
    del table  # its bytes are in the arrays
    doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
    if not len(features):
        return model
    tags = token_tags(features, doc, toxic)
    if tags.any():
        chain = np.cumsum(place == 0, dtype=np.int32) - 1
        # Sentences with a toxic token all count; of the others one in a few, by position.
        hot = np.zeros(int(chain.max()) + 1, bool)
        hot[chain[tags]] = True
        every = max(1, int((~hot[chain]).sum() // max(clean_tokens, clean_times * hot[chain].sum())))
        rest = np.cumsum(~hot) % every == 0
        rows_used = (hot | rest)[chain]
        fit_chain(model, features[rows_used], np.cumsum(place[rows_used] == 0) - 1, place[rows_used].astype(np.int64), tags[rows_used])
    summaries = []
    for part in whole_documents(doc):
        own, first = place[part].astype(np.int64), int(doc[part.start])
        p = marginals(model.emission(features[part]), model.move, np.cumsum(own == 0) - 1, own)[0]
        summaries.append((first, Model.summary(p, doc[part] - first, int(doc[part.stop - 1]) - first + 1)))
    x = np.zeros((n, summaries[0][1].shape[1]))  # a document without tokens has zeros
    for first, part in summaries:
        x[first : first + len(part)] = part
    fit_top(model, x, toxic, size[1] / (size[0] + size[1]))
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, spans`` per row; ``spans``: ``start:end`` byte offsets of toxic runs, comma-joined.

    Null and empty texts get the score of a text without toxic tokens. Repeated rows are scored each. A long text, or a long sentence, is scored whole, in pieces of memory that grow
    with that one text only. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            scores, spans = [], []
            for a, b in slices(offsets):
                t = Tokens(data, offsets[a : b + 1])
                p = model.tokens(t)
                scores.append(model.score(Model.summary(p, t.doc, b - a)))
                found: list[list[str]] = [[] for _ in range(b - a)]
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    new = np.concatenate([[True], (np.diff(bad) > 1) | (np.diff(t.chain[bad]) > 0)])
                    heads = np.flatnonzero(new)
                    tails = np.concatenate([heads[1:], [len(bad)]]) - 1
                    for x, y in zip(bad[heads], bad[tails], strict=True):
                        d = int(t.doc[x])
                        at = int(offsets[a + d] - offsets[a])
                        found[d].append(f"{int(t.starts[x]) - at}:{int(t.ends[y]) - at}")
                spans += [",".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, spans string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, remainder("doc_id", 4) != 2)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
