"""Features of posts: telling n-grams, raw features per case and their numeric slots."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions import text as T


#: Numbers of a skeleton's characters; a space is 0. Seven bits each, so that five fit in a whole number.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(ord("а"), ord("я") + 1)])) + "ё" + T.KAZAKH + "І"
CODES = np.zeros(0x600, np.int64)
CODES[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
BITS = 7
BASE = 1 << BITS


def _number(gram: str) -> int:
    n = 0
    for c in gram:
        n = n * BASE + int(CODES[ord(c)])
    return n


def _gram(n: int) -> str:
    out = ""
    while n:
        n, c = divmod(n, BASE)
        out = LETTERS[c - 1] + out
    return out


@lru_cache(maxsize=1 << 16)
def _short(word: str) -> int:
    """The number of a word of at most 5 characters if it may be a character gram too, else -1."""
    return _number(word) if all(c in LETTERS for c in word) else -1


#: Bits of a gram's place where both are sorted as one number.
PLACE_BITS = 28


def _inner(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The character grams of a skeleton (``codes``, a 0 at both ends) without the spaces at their ends, as numbers in rising order: how often each occurs and where first."""
    space, at = codes == 0, np.arange(len(codes))
    first = np.maximum.accumulate(np.where(space, at, 0))  # the space before each place
    length = np.diff(np.append(np.flatnonzero(space), len(codes)))[np.cumsum(space) - 1]  # of the word behind that space, and the space
    place = 2 * first + at  # by word, then n, then place
    number, within = codes[:-1] << BITS | codes[1:], np.zeros(len(codes) - 1, bool)
    grams, order = [], []
    for n in (3, 4, 5):
        number, within = number[:-1] << BITS | codes[n - 1 :], within[:-1] | space[n - 2 : -1]
        ok = np.flatnonzero(~within)
        found = number[ok]
        grams.append(found >> BITS * (found & BASE - 1 == 0))
        order.append(place[ok] + (n - 3) * length[ok])
    grams, order = np.concatenate(grams), np.concatenate(order)
    if 3 * len(codes) < 1 << PLACE_BITS:
        both = np.sort(grams << PLACE_BITS | order)
        grams, order = both >> PLACE_BITS, both & (1 << PLACE_BITS) - 1
    else:
        by = np.lexsort((order, grams))
        grams, order = grams[by], order[by]
    fresh = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[fresh], np.diff(np.append(fresh, len(grams))), order[fresh]


def _best(times: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The k places of most times, of equal ones those of the least order, the first one first."""
    some = np.flatnonzero(times)
    if len(some) > k:
        least = np.partition(times, -k)[-k]
        some, tied = np.flatnonzero(times > least), np.flatnonzero(times == least)
        left = k - len(some)
        some = np.concatenate([some, tied[np.argpartition(order[tied], left - 1)[:left]]])
    return some[np.lexsort((order[some], -times[some]))]


def _most(counted: Counter, k: int) -> list[tuple]:
    """Those of most weight, equal ones in the order they were first seen; not sorted."""
    if len(counted) <= k:
        return list(counted.items())
    least = sorted(counted.values(), reverse=True)[k - 1]
    above = [(w, n) for w, n in counted.items() if n > least]
    return above + list(islice(((w, n) for w, n in counted.items() if n == least), k - len(above)))


def _ranked(words: list[str], codes: np.ndarray, k: int) -> list[tuple[str, int]]:
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    grams, times, order = _inner(codes)
    short = [(w, n) for w in counts if len(w) <= 5 and (n := _short(w)) >= 0]
    if short and len(grams):
        numbers = np.array([n for _, n in short])
        at = np.minimum(np.searchsorted(grams, numbers), len(grams) - 1)
        for j in np.flatnonzero(grams[at] == numbers):
            counts[short[j][0]] += int(times[at[j]])
            times[at[j]] = 0  # counted as a word
    found = [*_most(counts, k), *((f"{a} {b}", 2 * n) for (a, b), n in _most(pairs, k)), *((_gram(int(grams[j])), int(times[j])) for j in _best(times, order, k))]
    return sorted(found, key=lambda g: -g[1])[:k]


def _ranks(read: Callable[..., tuple[list[str], np.ndarray]], rows: DataFrame, k: int) -> DataFrame:
    """``case_id, gram, n`` of what ``read`` makes of a row: its words and the codes of its skeleton."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i.as_py(), g, n) for i, *of in zip(*batch.columns, strict=True) for g, n in _ranked(*read(*(x.as_py() for x in of)), k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["case_id", "gram", "n"])

    return rows.mapInArrow(run, "case_id long, gram string, n long")


def top_ngrams(tokens: DataFrame, k: int) -> DataFrame:
    """``case_id, gram, n`` from rows ``case_id, w, s`` (the words and the skeleton of a case): per case the k grams of most weight.

    Words weigh 1, pairs of neighbours 2, character 3- to 5-grams of the skeleton's words, with a space at both ends that does not show, 1;
    of equal weights the first seen: words, then pairs, then characters.  All grams of a case come from one row, so they are
    counted in that row, the characters' as whole numbers in arrays: no gram is shuffled.  A null is an empty text.
    """

    def read(words: list[str] | None, skeleton: str | None) -> tuple[list[str], np.ndarray]:
        return words or [], np.concatenate([[0], CODES[np.frombuffer((skeleton or "").encode("utf-32-le"), np.uint32)], [0]])

    return _ranks(read, tokens.select(F.col("case_id").cast("long").alias("case_id"), "w", "s"), k)


WORDS = re.compile(f"[{T.WORD}]+")
#: Whether a character is one of a word; its last place stands for all characters behind it.
IN_WORD = np.array([WORDS.match(chr(c)) is not None for c in range(0x601)])


def _kinds() -> np.ndarray:
    table = np.full(0x3002, -1, np.int64)  # its last place stands for all characters behind it
    lookalikes = str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)
    for n in range(len(table) - 1):
        c = chr(n).translate(lookalikes)
        table[n] = CODES[ord(c)] if c in LETTERS else 0 if re.match(f"[{T.SEPARATORS}]", c) else -1
    return table


#: What a folded character is to a skeleton: the number of its letter, 0 for a separator, -1 for what ends a word.
KIND = _kinds()


def _skeleton(folded: str) -> np.ndarray:
    """The codes of ``T.skeleton``: letters with nothing but separators between them are neighbours."""
    kind = KIND[np.minimum(np.frombuffer(folded.encode("utf-32-le"), np.uint32), len(KIND) - 1)]
    at = np.flatnonzero(kind > 0)
    ends = np.flatnonzero(np.diff(np.cumsum(kind < 0)[at])) + 1
    return np.concatenate([[0], np.insert(kind[at], ends, 0), [0]])


def folded(text: str | None) -> str:
    """The text after NFKC and case folding, as ``T.nfkc_casefold`` gives it."""
    return (text or "").lower() if (text or "").isascii() else unicodedata.normalize("NFKC", text).casefold()


def text_ngrams(texts: DataFrame, k: int) -> DataFrame:
    """``top_ngrams`` of rows ``case_id, text``, with ``T.folded_words`` and ``T.skeleton`` of a text taken in the pass that counts: what goes to Python is the text alone, and each is folded once."""

    def read(text: str | None) -> tuple[list[str], np.ndarray]:
        plain = folded(text)
        return WORDS.findall(plain), _skeleton(plain)

    return _ranks(read, texts.select(F.col("case_id").cast("long").alias("case_id"), "text"), k)


#: Constants of the public hash XXH64.
PRIMES = tuple(np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _round(lane: np.ndarray, state: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turned(lane * PRIMES[1] + state, 31) * PRIMES[0]


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 (unsigned) of pieces of ``data``, all at once: a step goes over all pieces that are long enough for it."""
    one, two, three, four, five = PRIMES
    n = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # eight bytes from each place
    h = np.full(len(n), seed, np.uint64) + five
    most = np.flatnonzero(n >= 32)
    if len(most):
        v = [np.full(len(most), (seed + int(a)) % (1 << 64), np.uint64) for a in (int(one) + int(two), two, 0, -int(one))]
        some, at, left = np.arange(len(most)), starts[most], n[most] // 32
        while len(some):
            for k in range(4):
                v[k][some] = _round(lanes[at + 8 * k], v[k][some])
            on = left > 1
            some, at, left = some[on], at[on] + 32, left[on] - 1
        total = sum(_turned(x, b) for x, b in zip(v, (1, 7, 12, 18)))
        for x in v:
            total = (total ^ _round(x)) * one + four
        h[most] = total
    h += n.astype(np.uint64)
    at, left = starts + n // 32 * 32, n % 32
    for k in range(3):
        some = np.flatnonzero(left >= 8 * (k + 1))
        h[some] = _turned(h[some] ^ _round(lanes[at[some] + 8 * k]), 27) * one + four
    at += left // 8 * 8
    some = np.flatnonzero(left & 4)
    h[some] = _turned(h[some] ^ (lanes[at[some]] & np.uint64(0xFFFFFFFF)) * one, 23) * two + three
    at += left & 4
    for k in range(3):
        some = np.flatnonzero(left & 3 > k)
        h[some] = _turned(h[some] ^ padded[at[some] + k].astype(np.uint64) * five, 11) * one
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def seed_of(seed: int) -> int:
    """The seed that Spark's ``xxhash64(seed, x)`` has for ``x``."""
    return int(xxhash64(np.frombuffer(seed.to_bytes(4, "little", signed=True), np.uint8), np.array([0]), np.array([4]), 42)[0])


def gram_hashes(texts: list[str | None], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spark's ``xxhash64(seed, gram)`` of ``T.word_ngrams(T.folded_words(text))`` of all texts, and the text of each one."""
    plain = [folded(x) + " " for x in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)
    inside = IN_WORD[np.minimum(codes, len(IN_WORD) - 1)]
    last = np.flatnonzero(inside[:-1] & ~inside[1:])  # of each word; behind it stands what is no part of one
    row = np.searchsorted(np.cumsum([len(x) for x in plain]), last, "right")
    if not len(row):
        return np.zeros(0, np.int64), row
    # Words with one space between them: a pair of neighbours is one piece too.
    inside[last + 1] = True
    codes = codes.copy()
    codes[last + 1] = ord(" ")
    data = np.frombuffer(codes[inside].tobytes().decode("utf-32-le").encode(), np.uint8)
    ends = np.flatnonzero(data == ord(" "))
    starts, pairs = np.append(0, ends[:-1] + 1), np.flatnonzero(row[1:] == row[:-1])
    found = xxhash64(data, np.concatenate([starts, starts[pairs]]), np.concatenate([ends, ends[pairs + 1]]), seed_of(seed))
    return found.view(np.int64), np.concatenate([row, row[pairs]])


#: Characters of skeletons, or of texts, counted at once.
AT_ONCE = 1 << 20


def _windows(skeletons: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The character 3- to 5-grams of the words, spaces at their ends included, and how often each occurs."""
    codes = CODES[np.frombuffer(f" {' '.join(skeletons)} ".encode("utf-32-le"), np.uint32)]
    letters = np.array([" ", *LETTERS], "U1").view(np.uint32)
    for n in (3, 4, 5):
        m = max(0, len(codes) - n + 1)
        number, ok = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            number = number * BASE + codes[k : k + m]
            if 0 < k < n - 1:
                ok &= codes[k : k + m] != 0
        found, times = np.unique(number[ok], return_counts=True)
        digits = np.stack([found // BASE ** (n - 1 - k) % BASE for k in range(n)], 1)
        yield np.ascontiguousarray(letters[digits]).view(f"U{n}").ravel(), times


def char_gram_counts(skeletons: DataFrame) -> DataFrame:
    """``gram, n`` over all rows of ``s``: character 3- to 5-grams of a skeleton's words with a space at both ends.

    They are counted as whole numbers, AT_ONCE characters at a time (a row is not cut), so what is shuffled are counts.  Words of a
    skeleton may be as long as a text, as separators between letters are gone, so no gram is cut out by its place in a string.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            for grams, times in _windows(held):
                yield pa.RecordBatch.from_arrays([pa.array(grams.tolist(), pa.string()), pa.array(times, pa.int64())], ["gram", "n"])

        held, size = [], 0
        for batch in batches:
            for s in batch.column("s"):
                text = s.as_py()
                if text:
                    held.append(text)
                    size += len(text)
                if size >= AT_ONCE:
                    yield from counted()
                    held, size = [], 0
        yield from counted()

    return skeletons.select("s").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


KINDS = tuple(config.LINK_FORMATS)
BEHAVIOURS = ("urgency", "referral", "messenger")


def raw_features(posts: DataFrame, hits: DataFrame, links: DataFrame, images: DataFrame, segments: DataFrame, media: DataFrame, texts: DataFrame, kb: DataFrame) -> DataFrame:
    """One row per post: behaviour (strongest / 100 per dimension, their number, strongest negative), contacts by kind, best image score per
    dimension, duration, spoken segments, tags, whole text, language, and the knowledge base's likeness (0 to 1).

    Each input is one partial aggregate by case; what a case lacks is 0.
    """
    own = F.col("source") == "Behavior"
    most = lambda when: F.coalesce(F.max(F.when(when, F.col("confidence"))), F.lit(0.0)) / 100
    behaviour = hits.groupBy("case_id").agg(*[most(own & (F.col("dim") == d)).alias(f"behavior_{d}") for d in BEHAVIOURS], F.count_if(own).alias("behavior_count"), most(F.col("dim") == "negative").alias("behavior_negative"))
    contacts = links.groupBy("case_id").agg(*[F.count_if(F.col("kind") == k).alias(f"link_{k}") for k in KINDS])
    seen = images.where("dim <> ''").groupBy("case_id").agg(*[F.max(F.when(F.col("dim") == d, F.col("score"))).alias(f"visual_{d}") for d in config.DIMENSIONS])
    spoken = segments.where(F.trim("text") != "").groupBy("case_id").agg(F.count("*").alias("num_segments"))
    base = posts.select("case_id", "hashtags")
    parts = [texts, behaviour, contacts, seen, spoken, media.select("case_id", "duration_s"), kb.select("case_id", (F.col("kb_score") / 100).alias("kb_similarity"))]
    joined = reduce(lambda a, b: a.join(b, "case_id", "left"), parts, base)
    numbers = [c for c in joined.columns if c not in ("case_id", "hashtags", "text")]
    return joined.select("case_id", "hashtags", F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers]).withColumn("lang_hint", T.language_hint(F.col("text")))


# Caps and codes of the numeric slots.
LANG_CODES = {"": 0.0, "ru": 0.0, "kz": 0.33, "en": 0.66, "mixed": 1.0}
SLOTS = (
    *(f"visual.{d}" for d in config.DIMENSIONS), "behavior.urgency", "behavior.referral", "behavior.messenger", "behavior.count", "behavior.negative",
    "link.telegram", "link.whatsapp", "link.url", "link.promocode", "link.phone", "link.total", "kb_similarity", "duration_s", "num_segments", "hashtag_count",
    "hashtag.suspicious_ratio", "text_len", "has_url", "has_telegram_or_wa", "has_promocode", "digit_ratio", "emoji_zerowidth_count", "profit_density", "lang_code",
)


# The dimension that each slot speaks for, in the order of SLOTS; none where it speaks for all.
SLOT_DIMENSIONS = (
    *config.DIMENSIONS, "urgency", "referral", "messenger", "", "",
    "messenger", "messenger", "messenger", "referral", "messenger", "messenger", "reused", "", "", "hashtags",
    "hashtags", "", "messenger", "messenger", "referral", "", "", "profit", "",
)


def numeric_slots(raw: DataFrame, tag_anchors: tuple[str, ...], text_anchors: tuple[str, ...]) -> list[Column]:
    """The 32 numeric features of ``raw_features``, each between 0 and 1, in the order of SLOTS; column expressions only."""
    c = F.col
    share = lambda x, most: F.least(x.cast("double"), F.lit(float(most))) / most
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    total = reduce(lambda a, b: a + b, [c(f"link_{k}") for k in KINDS])
    lang = F.element_at(F.create_map(*[F.lit(x) for kv in LANG_CODES.items() for x in kv]), c("lang_hint"))
    return [
        *(c(f"visual_{d}").cast("double") for d in config.DIMENSIONS),
        *(c(f"behavior_{d}") for d in BEHAVIOURS),
        share(c("behavior_count"), 5),
        c("behavior_negative"),
        *(share(c(f"link_{k}"), 4) for k in ("telegram", "whatsapp", "url", "promocode", "phone")),
        share(total, 8),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("kb_similarity").cast("double"))),
        F.least(F.log1p(F.greatest(F.lit(0.0), c("duration_s"))) / F.log1p(F.lit(600.0)), F.lit(1.0)),
        share(c("num_segments"), 40),
        share(F.size("hashtags"), 12),
        T.suspicious_tags(F.transform("hashtags", T.fold_lookalikes), tag_anchors),
        T.log_length(c("text")),
        yes(c("link_url") > 0),
        yes((c("link_telegram") > 0) | (c("link_whatsapp") > 0)),
        yes(c("link_promocode") > 0),
        T.digit_ratio(c("text")),
        T.emoji_share(c("text")),
        T.anchor_density(c("text"), text_anchors),
        F.coalesce(lang, F.lit(0.0)),
    ]


def numeric_table(raw: DataFrame, tag_anchors: tuple[str, ...], text_anchors: tuple[str, ...]) -> DataFrame:
    """``case_id, v0 .. v31``."""
    return raw.select("case_id", *[x.alias(f"v{k}") for k, x in enumerate(numeric_slots(raw, tag_anchors, text_anchors))])
