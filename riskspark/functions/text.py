"""Text and scalar column functions. All are built-in expressions but for NFKC, which Spark lacks, and the counts of characters by kind."""

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskspark import config

# Look-alike and digit substitutes and the letters they stand for.
CONFUSABLE_FROM, CONFUSABLE_TO = "aeopcxykmhtbnru013456789@$", "аеорсхукмнтвпгиоиечѕбтв9аѕ"
KAZAKH = "әғқңөұүһі"
# Letters of a skeleton, characters of a word, separators that may stand within a disguised word.
LETTERS = f"a-zа-яё{KAZAKH}І"
WORD = f"a-zа-яё{KAZAKH}0-9#"
SEPARATORS = r"\s\x1c-\x1f.\-_*·•|/\\\u200b\u200c\u200d\u2060"


def all_text(*parts: Column) -> Column:
    """Non-blank parts joined by line breaks."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def joined(parts: list[Column], by: str) -> Column:
    return F.concat_ws(by, *[F.when(p != "", p) for p in parts])


def kb_text(c: Column) -> Column:
    """Trim, lower, and one letter for ё and е."""
    return F.replace(F.lower(F.trim(c)), F.lit("ё"), F.lit("е"))  # translate would look up every character


def kb_handle(c: Column) -> Column:
    """A handle without scheme, host, at-sign (each once, in this order) and slashes."""
    c = kb_text(c)
    for lead in ("^https?://", "^t\\.me/", "^telegram\\.me/", "^@"):
        c = F.regexp_replace(c, lead, "")
    return F.regexp_replace(c, "^/+|/+$", "")


def kb_tag(c: Column) -> Column:
    """``#`` and the tag without underscores; an empty one stays empty."""
    bare = F.replace(F.regexp_replace(kb_text(c), "^#+", ""), F.lit("_"), F.lit(""))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("#"), bare))


def clip(c: Column, most: int = 160) -> Column:
    """Text cut at ``most`` characters, with a mark where it was."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("…"))).otherwise(c)


def sentence_around(text: Column, at: Column, size: Column) -> Column:
    """The sentence that holds the ``size`` characters from offset ``at`` (1-based), trimmed and cut."""
    # Read backwards from the offset: a pattern tied to the end would be tried from every place before it.
    left = F.reverse(F.regexp_extract(F.reverse(F.substring(text, F.lit(1), at - 1)), r"^[^.!?\n]*", 0))
    right = F.regexp_extract(F.substring(text, at + size, F.length(text)), r"^[^.!?\n]*", 0)
    return clip(F.trim(F.concat(left, F.substring(text, at, size), right)))


def quote(c: Column) -> Column:
    """White space collapsed, cut to 157 and a mark above 160, in guillemets; nothing for nothing."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r]+", " "))
    cut = F.when(F.length(flat) > 160, F.concat(F.rtrim(F.substring(flat, 1, 157)), F.lit("…"))).otherwise(flat)
    return F.when(flat == "", "").otherwise(F.concat(F.lit("«"), cut, F.lit("»")))


def _seconds(c: Column) -> Column:
    return F.bround(F.greatest(c.cast("double"), F.lit(0.0))).cast("long")


def clock(c: Column) -> Column:
    s = _seconds(c)
    minutes = F.floor(s / 60).cast("string")  # lpad would cut off what is longer than two digits
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def short_clock(c: Column) -> Column:
    s = _seconds(c)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def clamp(c: Column) -> Column:
    """0 to 100, rounded half to even."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(c.cast("double")).cast("int")))


def _band(c: Column, bands: tuple[tuple[str, float], ...]) -> Column:
    out = None
    for name, least in bands:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise("low")


def risk_level(score: Column) -> Column:
    return _band(score, config.LEVELS)


def severity(confidence: Column) -> Column:
    return _band(confidence, config.SEVERITIES)


def severity_rank(confidence: Column) -> Column:
    return F.when(confidence >= 85, 3).when(confidence >= 65, 2).when(confidence >= 45, 1).otherwise(0)


#: Characters that NFKC leaves as they are beside each other, and whose case folding is their small letter: ASCII, letters of Latin-1 but for the sharp s, Cyrillic, quotation marks, dash.
SETTLED = "\\x00-\\x7fÀ-Þà-ÿЀ-ҁҊ-ӿ«»—"


def nfkc_casefold(c: Column) -> Column:
    """Unicode NFKC and case folding.  No built-in does this, so texts go through Arrow batches, but only those that hold a character outside of SETTLED; for all others it is ``lower``."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    # Run over as a class from end to end: searching for what is outside of it takes Java's matcher about nine times as long.
    return F.coalesce(fold(F.when(~c.rlike(rf"\A[{SETTLED}]*+\z"), c)), F.lower(c))


def fold_lookalikes(c: Column) -> Column:
    return F.translate(F.lower(c), CONFUSABLE_FROM, CONFUSABLE_TO)


def collapse_separators(c: Column) -> Column:
    """A run of separators between two letters goes; every other run of what is no letter becomes one space; none at the ends."""
    joined_up = F.regexp_replace(c, rf"(?U)[{SEPARATORS}](?<=[{LETTERS}][{SEPARATORS}])[{SEPARATORS}]*+(?=[{LETTERS}])", "")
    return F.array_join(F.regexp_extract_all(joined_up, F.lit(f"([{LETTERS}]++)"), F.lit(1)), " ")


def skeleton(c: Column) -> Column:
    """Text as it is compared against disguises: NFKC and case folding, look-alikes, then separators."""
    return collapse_separators(F.translate(nfkc_casefold(c), CONFUSABLE_FROM, CONFUSABLE_TO))


def words(c: Column) -> Column:
    """Lower-case runs of letters, digits and number signs."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]+)"), F.lit(1))


def folded_words(c: Column) -> Column:
    """``words`` after NFKC and case folding: the light word stream of the model."""
    return words(nfkc_casefold(c))


def has_words(c: Column) -> Column:
    """Whether ``folded_words`` are any, without making them."""
    return F.lower(nfkc_casefold(c)).rlike(f"[{WORD}]")


def word_ngrams(tokens: Column) -> Column:
    """Words, then pairs of neighbours joined by a space."""
    n = F.size(tokens)
    return F.when(n > 1, F.concat(tokens, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(tokens)


def char_ngrams(tokens: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams of every word with a space at both ends."""

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda k: F.substring(padded, k, n))).otherwise(F.array().cast("array<string>"))))

    return F.flatten(F.transform(tokens, grams))


#: What a character counts as, by its number: Cyrillic, Latin and Kazakh letters of both cases (with the two signs whose small letter is Latin), digits, emoji and zero-width marks.
COUNTED = {"cyrillic": "а-яА-ЯёЁ", "latin": "a-zA-Zİ\u212a", "kazakh": KAZAKH + KAZAKH.upper(), "digits": "0-9", "marks": "\U0001f300-\U0001faff☀-➿\u200b\u200c\u200d"}
#: Bytes of text counted at once.
COUNTED_AT_ONCE = 1 << 20


def _kinds() -> np.ndarray:
    table = np.zeros(0x1FB01, np.uint8)  # its last place stands for all characters behind it
    for k, characters in enumerate(COUNTED.values(), 1):
        for first, last in re.findall("(?s)(.)(?:-(.))?", characters):
            table[ord(first) : ord(last or first) + 1] = k
    return table


KINDS = _kinds()


def _counts(texts: list[str | None]) -> np.ndarray:
    codes = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(x or "") for x in texts])
    return np.bincount(row * 8 + KINDS[np.minimum(codes, len(KINDS) - 1)], minlength=8 * len(texts)).reshape(-1, 8)


@F.arrow_udf(StructType([StructField(k, LongType()) for k in COUNTED]))
def character_counts(c: pa.Array) -> pa.Array:
    """How many characters of each kind of COUNTED a text holds: all kinds in one pass over Arrow batches, a slice of about COUNTED_AT_ONCE bytes at a time.

    Matched with patterns, every letter is an item of an array, for each kind and each place of the expression that reads it.
    """
    ends = np.cumsum(pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)) // COUNTED_AT_ONCE
    starts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(c)] if len(c) else [0]
    found = [_counts(c.slice(a, b - a).to_pylist()) for a, b in zip(starts, starts[1:])]
    n = np.concatenate(found) if found else np.zeros((0, 8), np.int64)
    return pa.StructArray.from_arrays([pa.array(n[:, k], pa.int64()) for k in range(1, len(COUNTED) + 1)], list(COUNTED), mask=c.is_null())


def language_hint(c: Column) -> Column:
    """kz, ru, en, mixed or nothing, from the shares of Cyrillic and Latin letters."""
    n = character_counts(F.coalesce(c, F.lit("")))
    cyrillic, latin = (n["cyrillic"] + n["kazakh"]).cast("double"), n["latin"].cast("double")
    total = cyrillic + latin
    share = cyrillic / total
    return F.when(total == 0, "").when((n["kazakh"] > 0) & (share > 0.3), "kz").when((share > 0.25) & (share < 0.75), "mixed").when(share >= 0.75, "ru").otherwise("en")


def looks_obfuscated(c: Column) -> Column:
    """Zero-width marks, spaced-out words, Latin look-alikes beside Cyrillic, digits between letters."""
    text = F.coalesce(c, F.lit(""))
    return (
        text.rlike("[​‌‍﻿]")
        | text.rlike(r"(?iu)([а-яёa-z][ \t\n\r.\-_]){3,}[а-яёa-z]")
        | (text.rlike("(?iu)[а-яё]") & text.rlike("[aeopcxykmhtbAEOPCXYKMHTB]"))
        | text.rlike("(?iu)[а-яёa-z][013456780][а-яёa-z]")
    )


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) > 0, character_counts(c)["digits"] / F.length(c)).otherwise(0.0)


def emoji_share(c: Column) -> Column:
    return F.least(character_counts(c)["marks"], F.lit(20)) / 20.0


def log_length(c: Column) -> Column:
    return F.least(F.log1p(F.length(c)) / F.log1p(F.lit(2000.0)), F.lit(1.0))


#: What each ASCII character stands for in ``fold_lookalikes``.
STANDS_FOR = np.arange(128, dtype=np.uint32)
STANDS_FOR[[ord(c) for c in CONFUSABLE_FROM]] = [ord(c) for c in CONFUSABLE_TO]


def _lookalikes(text: str) -> str:
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, STANDS_FOR[np.minimum(codes, 127)], codes).astype(np.uint32).tobytes().decode("utf-32-le")


def anchor_density(text: Column, anchors: tuple[str, ...]) -> Column:
    """Non-overlapping occurrences of anchors in ``fold_lookalikes(text)``, 5 at most, as a share of 5.

    Counted over Arrow batches, a text at a time: ``translate`` looks up every character as a string.
    """
    @F.arrow_udf("double")
    def hits(c: pa.Array) -> pa.Array:
        return pa.array([None if (x := t.as_py()) is None else float(sum(map(_lookalikes(x).count, anchors))) for t in c], pa.float64())

    return F.least(hits(text), F.lit(5.0)) / 5.0


def suspicious_tags(tags: Column, anchors: tuple[str, ...]) -> Column:
    """Share of tags that contain an anchor or lie within one."""
    bare = F.transform(tags, lambda t: F.replace(F.lower(t), F.lit("#"), F.lit("")))
    bad = F.filter(bare, lambda t: (t != "") & F.exists(F.array(*map(F.lit, anchors)), lambda a: t.contains(a) | a.contains(t)))
    return F.when(F.size(tags) > 0, F.size(bad) / F.size(tags)).otherwise(0.0)
