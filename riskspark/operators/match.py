"""Matching texts with rule tables: phrases, negative markers, contacts, calls to action.

Texts are rows (case_id, source_ord, source_field, place, time_s, text): the metadata, each spoken segment and each frame of a case; nothing is
put together to one long text per case.  All rules go over a text at once as one automaton, so the number of rules does not change the plan or
the hits.  "First" always means the smallest of (place, rule_ord, pos).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskspark import config
from riskspark.functions.text import clip

HIT = ("case_id", "lane", "source", "seg_no", "rule_ord", "pos", "confidence", "signal", "fragment", "time_s", "dim", "chip")
SOURCES = ("Metadata", "Audio", "OCR")
#: Rules of one automaton (some 100 bytes a character of pattern in each worker); more rules are more automata, one after the other.
RULES_AT_ONCE = 100_000
#: Hits that a worker holds before it hands them on.
FOUND_AT_ONCE = 1 << 12
PLACE = 10**12


def meta_text(posts: DataFrame) -> DataFrame:
    """``case_id, seg_no, time_s, text`` of title, description and tags."""
    return posts.select("case_id", F.lit(0).cast("long").alias("seg_no"), F.lit(None).cast("double").alias("time_s"), F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "description", "tags")]).alias("text"))


def all_texts(meta: DataFrame, speech: DataFrame, screen: DataFrame) -> DataFrame:
    """The texts of a case as rows; each input: case_id, seg_no, time_s, text.  ``place`` orders them: metadata, then speech, then frames."""
    parts = [(0, "description", meta), (1, "transcript", speech), (2, "ocr", screen)]
    return reduce(DataFrame.unionByName, [df.select("case_id", F.lit(k).alias("source_ord"), F.lit(name).alias("source_field"), (F.lit(k * PLACE).cast("long") + F.col("seg_no")).alias("place"), "time_s", "text") for k, name, df in parts])


#: Characters that a case-insensitive match holds for equal although neither has a form in the other case of one character.
TWINS = {"\u1fd3": "\u0390", "\u1fe3": "\u03b0", "\ufb05": "\ufb06"}


@lru_cache(maxsize=1 << 16)
def _fold_one(c: str) -> str:
    low = c.lower() if len(c.lower()) == 1 else c.lower()[0]  # the dotted capital I is the only one with a longer small form
    up = low.upper()
    return up if len(up) == 1 else TWINS.get(low, low)


def fold(text: str) -> str:
    """``text`` without case, character by character, so that places stay: two characters fold alike if a case-insensitive match takes one for the other."""
    if text.isascii():
        return text.upper()
    low = text.lower()
    up = low.upper()
    return up if len(low) == len(text) == len(up) else "".join(map(_fold_one, text))


def needed(regex: str) -> str:
    """A text that every match of ``regex`` holds: the longest run of plain characters outside of choices, groups and repetitions; empty if none is sure."""
    runs, run, k = [], "", 0
    while k < len(regex):
        c = regex[k]
        if c in "|()":
            return ""
        if c == "[":
            k = regex.find("]", k + 2)
            if k < 0:
                return ""
        if c == "\\":
            k += 1
            c = regex[k : k + 1]
            c = "[" if c.isalnum() else "\\" + c  # a class or an anchor ends a run, an escaped sign goes on
        if c in "?*{":  # what stands before need not occur
            runs.append(run[:-1])
            run = ""
            if c == "{":
                k = max(k, regex.find("}", k))
        elif c in ("[", ".", "^", "$", "+"):
            runs.append(run)
            run = ""
        else:
            run += c[-1]
        k += 1
    return max([*runs, run], key=len)


class Scanner:
    """All rules as one automaton over folded text.

    Plain patterns are its words.  A regular expression is looked for only in texts in which the automaton meets the text that it needs, or in all if it needs none.
    """

    def __init__(self, rules: list[tuple[int, str, bool, bool]], case: bool = False):
        self.fold = (lambda text: text) if case else fold
        self.automaton = ahocorasick.Automaton()
        self.regexes, self.always = {}, []
        words: dict[str, list[int]] = {}
        self.size = {}
        for n, pattern, is_regex, _ in rules:
            if is_regex:
                self.regexes[n] = re.compile(pattern, 0 if case else re.IGNORECASE)
                pattern = needed(pattern)
                if not pattern:
                    self.always.append(n)
            if pattern:
                words.setdefault(self.fold(pattern), []).append(n)
                self.size[n] = len(pattern)
        for word, of in words.items():
            self.automaton.add_word(word, tuple(of))
        if words:
            self.automaton.make_automaton()
        self.empty = not words
        self.labelled = {n for n, _, _, labelled in rules if labelled}

    def hits(self, text: str, every: bool) -> Iterator[tuple[int, int, str, str]]:
        """(rule, place from 0, matched text, its chip) of each rule's occurrences, which do not overlap; else the first one of each chip."""
        met, upto = set(self.always), {}
        seen: set[tuple[int, str]] = set()

        def shown(n: int, at: int, matched: str) -> bool:
            # Whether to show it; a labelled rule has one chip.
            key = (n, "" if n in self.labelled else matched.strip().lower())
            if every or key not in seen:
                seen.add(key)
                return True
            return False

        for end, of in self.automaton.iter(self.fold(text)) if not self.empty else ():
            for n in of:
                if n in self.regexes:
                    met.add(n)
                    continue
                start = end + 1 - self.size[n]
                if start >= upto.get(n, 0):
                    upto[n] = end + 1
                    matched = text[start : end + 1]
                    if shown(n, start, matched):
                        yield n, start, matched, matched.strip().lower()
        for n in sorted(met):
            for m in self.regexes[n].finditer(text):
                if m[0] and shown(n, m.start(), m[0]):
                    yield n, m.start(), m[0], m[0].strip().lower()


def sentence(text: str, start: int, size: int, most: int = 160) -> str:
    """The sentence that holds the match, trimmed and cut."""
    left = max(text.rfind(c, 0, start) for c in ".!?\n") + 1
    ends = [e for e in (text.find(c, start + size) for c in ".!?\n") if e >= 0]
    whole = text[left : min(ends, default=len(text))].strip(" ")
    return whole[:most].rstrip(" ") + "…" if len(whole) > most else whole


_scanners: dict[str, Scanner] = {}


def _scan(batches: Iterable[pa.RecordBatch], key: str, shared, case: bool, every: bool) -> Iterator[pa.RecordBatch]:
    if key not in _scanners:  # one per worker and rule table
        _scanners.clear()
        _scanners[key] = Scanner(shared.value, case)
    scanner = _scanners[key]
    for batch in batches:
        others = [n for n in batch.schema.names if n != "text"]
        rows, found = [], []

        def given() -> pa.RecordBatch:
            ord_, pos, matched, size, chip, fragment = zip(*found, strict=True) if found else ((),) * 6
            kept = [batch.column(n).take(pa.array(rows, pa.int64())) for n in others]
            return pa.RecordBatch.from_arrays([*kept, pa.array(ord_, pa.int64()), pa.array(pos, pa.int32()), pa.array(matched, pa.string()), pa.array(size, pa.int32()), pa.array(chip, pa.string()), pa.array(fragment, pa.string())], [*others, "__ord", "pos", "matched", "size", "chip", "fragment"])

        # One text and FOUND_AT_ONCE hits at a time, whatever the session's batches hold.
        for k, text in enumerate(batch.column("text")):
            text = text.as_py()
            for n, start, matched, chip in scanner.hits(text, every) if text else ():
                rows.append(k)
                found.append((n, start + 1, matched, len(matched), chip, sentence(text, start, len(matched))))
                if len(found) >= FOUND_AT_ONCE:
                    yield given()
                    rows, found = [], []
        yield given()


def _schema(df: DataFrame, but: str, more: str) -> StructType:
    """The columns of ``df`` but one, and ``more``."""
    return StructType([f for f in df.schema.fields if f.name != but] + StructType.fromDDL(more).fields)


def find_matches(texts: DataFrame, rules: DataFrame, every: bool = True, case: bool = False) -> DataFrame:
    """Occurrences of each rule in each text: the columns of ``texts`` but the text, the rule's columns, ``pos`` (1-based), ``matched``, ``size``, ``chip``, ``fragment``.

    ``rules``: ord (its number, unique), pattern, is_regex, label and what else is to be carried; any number of them.  Case does not count (unless ``case``), by one rule for
    plain patterns and regular expressions: that of ``fold``.  The chip is the label, or the matched text in lower case.  ``every=False`` gives the first occurrence of each chip only.

    A text is read once for RULES_AT_ONCE rules, whatever their number; what travels is one row per occurrence.
    """
    spark = texts.sparkSession
    rows = rules.select(F.col("ord").cast("long"), "pattern", F.coalesce("is_regex", F.lit(False)), F.coalesce("label", F.lit("")) != "").where("coalesce(pattern, '') <> ''")
    n = rows.count()
    groups = [rows] if n <= RULES_AT_ONCE else [rows.where(F.pmod(F.xxhash64("ord"), F.lit(-(-n // RULES_AT_ONCE))) == k) for k in range(-(-n // RULES_AT_ONCE))]
    schema = _schema(texts, "text", "__ord long, pos int, matched string, size int, chip string, fragment string")

    def one(group: DataFrame) -> DataFrame:
        shared, key = spark.sparkContext.broadcast([tuple(r) for r in group.collect()]), uuid.uuid4().hex
        return texts.mapInArrow(lambda batches: _scan(batches, key, shared, case, every), schema)

    found = reduce(DataFrame.unionByName, map(one, groups))
    joined = found.join(rules, F.col("__ord") == F.col("ord"))
    kept = [c for c in texts.columns if c != "text"]
    return joined.select(*kept, *[F.col(c) for c in rules.columns], "matched", "pos", "size", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("chip")).alias("chip"), "fragment")


def count_phrases(found: DataFrame) -> DataFrame:
    """``case_id, ord, n``: all non-overlapping occurrences of each rule."""
    return found.groupBy("case_id", "ord").agg(F.count("*").alias("n"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def all_rules(lexicon: DataFrame, negatives: DataFrame, calls: DataFrame) -> DataFrame:
    """One table of the three kinds of rules; ``ord`` is unique, ``rule_ord`` a rule's number within its kind.

    A call counts with every text that it matches, so it has no label here and its tag is apart.
    """
    kinds = [("phrase", lexicon.withColumns({"signal": F.lit(""), "tag": F.lit("")})), ("negative", negatives.withColumns({"dim": F.lit("negative"), "is_regex": F.lit(False), "label": F.lit(""), "signal": F.lit(""), "tag": F.lit("")})), ("call", calls.withColumn("tag", F.col("label")).withColumn("label", F.lit("")))]
    parts = [df.select((F.col("ord") + k * 1_000_000).alias("ord"), F.col("ord").alias("rule_ord"), F.lit(kind).alias("kind"), "dim", "pattern", "weight", "is_regex", "label", "signal", "tag") for k, (kind, df) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, parts)


def scan(found: DataFrame) -> DataFrame:
    """Dimension hits from matches of phrases (``find_matches`` with ``all_rules``); per case, source, dimension and chip the first."""
    hits = first_per(found.where("kind = 'phrase'"), ["case_id", "source_ord", "dim", "chip"], ["place", "rule_ord", "pos"])
    source = F.element_at(F.array(*map(F.lit, SOURCES)), F.col("source_ord") + 1)
    return hits.select("case_id", F.lit(1).alias("lane"), source.alias("source"), F.col("place").alias("seg_no"), "rule_ord", "pos", F.col("weight").cast("double").alias("confidence"), F.col("chip").alias("signal"), "fragment", "time_s", "dim", "chip")


def scan_negatives(found: DataFrame) -> DataFrame:
    """Hits of negative markers in all texts of a case, each marker once, without a time."""
    hits = first_per(found.where("kind = 'negative'"), ["case_id", "chip"], ["place", "rule_ord", "pos"])
    return hits.select("case_id", F.lit(1).alias("lane"), F.lit("Metadata").alias("source"), F.col("place").alias("seg_no"), "rule_ord", "pos", F.col("weight").cast("double").alias("confidence"), F.col("chip").alias("signal"), "fragment", F.lit(None).cast("double").alias("time_s"), "dim", "chip")


def link_values(text: Column, kind: str, regex: str) -> Column:
    """Group 1 of all matches.  A format is tried only on texts, or words of a text where it holds no white space, with what every match of it needs: tried from every place of a text
    the one of addresses alone takes several times as long as all others."""
    of = lambda c: F.regexp_extract_all(c, F.lit("(?iu)" + regex), F.lit(1))
    need = config.LINK_NEEDS.get(kind)
    if need is None:
        return of(text)
    found = F.flatten(F.transform(F.filter(F.split(text, r"\s"), lambda w: w.rlike(need)), of)) if kind in config.LINK_UNBROKEN else of(text)
    return F.when(text.rlike(need), found).otherwise(F.array().cast("array<string>"))


def extract_links(texts: DataFrame) -> DataFrame:
    """``case_id, kind_ord, kind, value, source_field, place, at``: contacts of all texts, each kind and value once, first text first."""

    def found(k: int, kind: str, regex: str) -> Column:
        values = link_values(F.col("text"), kind, regex)
        return F.transform(values, lambda v, i: F.struct(F.lit(k).alias("kind_ord"), F.lit(kind).alias("kind"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value"), (i + 1).alias("at")))

    each = [found(k, kind, regex) for k, (kind, regex, *_) in enumerate(config.LINKS)]
    rows = texts.select("case_id", "source_field", "place", F.explode_outer(F.concat(*each)).alias("l")).select("case_id", "source_field", "place", "l.*").where("value <> ''")
    return first_per(rows.withColumn("low", F.lower("value")), ["case_id", "kind", "low"], ["place", "at"]).select("case_id", "kind_ord", "kind", "value", "source_field", "place", "at")


def link_hits(links: DataFrame) -> DataFrame:
    """A hit of source Metadata per link, with its kind's dimension and confidence."""
    kind = lambda at: F.element_at(F.create_map(*[x for k in config.LINKS for x in (F.lit(k[0]), F.lit(k[at]))]), F.col("kind"))
    return links.select("case_id", F.lit(0).alias("lane"), F.lit("Metadata").alias("source"), F.col("place").alias("seg_no"), F.col("kind_ord").alias("rule_ord"), F.col("at").alias("pos"), kind(3).cast("double").alias("confidence"), F.concat(kind(4), F.lit(": "), "value").alias("signal"), F.col("value").alias("fragment"), F.lit(None).cast("double").alias("time_s"), kind(2).alias("dim"), F.col("value").alias("chip"))


def funnel_hits(links: DataFrame, kinds: DataFrame) -> DataFrame:
    """A behaviour hit per link, that is per case, kind of contact and value (equi-join with the kinds)."""
    return links.join(kinds, "kind").select("case_id", F.lit(2).alias("lane"), F.lit("Behavior").alias("source"), F.col("place").alias("seg_no"), (100 + F.col("kind_ord")).alias("rule_ord"), F.col("at").alias("pos"), F.col("confidence").cast("double").alias("confidence"), F.concat("signal", F.lit(": "), "value").alias("signal"), clip(F.col("value")).alias("fragment"), F.lit(None).cast("double").alias("time_s"), "dim", F.col("value").alias("chip"))


def call_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, p, w, True, tag, s) for k, (p, w, s, d, tag) in enumerate(config.CALLS)], "ord int, dim string, pattern string, weight int, is_regex boolean, label string, signal string")


def call_hits(found: DataFrame, timed: DataFrame) -> DataFrame:
    """Behaviour hits of calls to action in all texts of a case, one per case, tag and matched text.

    Their time is that of the earliest row of ``timed`` (segments and frames) whose text contains the match.
    """
    low = F.lower(F.trim("matched"))
    once = first_per(found.where("kind = 'call'").withColumn("low", low), ["case_id", "tag", "low"], ["rule_ord", "place", "pos"])
    times = locate_times(once.select("case_id", F.col("low").alias("chip")), timed).withColumnRenamed("chip", "low")
    return once.join(times.withColumnRenamed("time_s", "t"), ["case_id", "low"], "left").select("case_id", F.lit(2).alias("lane"), F.lit("Behavior").alias("source"), F.col("place").alias("seg_no"), "rule_ord", "pos", F.col("weight").cast("double").alias("confidence"), "signal", clip(F.trim("matched")).alias("fragment"), F.col("t").alias("time_s"), "dim", F.col("tag").alias("chip"))


def locate_times(hits: DataFrame, timed: DataFrame) -> DataFrame:
    """Earliest segment or frame whose text contains the hit's chip: ``time_s`` per hit (case and chip)."""
    near = hits.select("case_id", "chip").distinct().join(timed.select("case_id", F.col("time_s").alias("t"), "text"), "case_id").where(F.contains(F.lower("text"), F.lower("chip")))
    return near.groupBy("case_id", "chip").agg(F.min("t").alias("time_s"))


def all_hits(*lanes: DataFrame) -> DataFrame:
    """Links, then texts, then behaviour."""
    return reduce(DataFrame.unionByName, [x.select(*HIT) for x in lanes])


def escalate(score: Column, text: Column, has_media: Column) -> Column:
    """Whether the expensive inputs are worth reading."""
    return has_media & ((score >= config.ESCALATE_SCORE) | (F.length(F.trim(text)) < config.THIN_TEXT))


#: Prompts that a frame is compared with at once.
PROMPTS_AT_ONCE = 4096


def _label(batches: Iterable[pa.RecordBatch], labels: list[str], dims: list[str], vectors: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Per frame the largest logit and the sum of exp(z - largest) over these prompts, and the prompts that can still pass ``least``."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    named = np.array([d != "" for d in dims])
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
            z = 100 * (x @ unit.T) / np.linalg.norm(x, axis=1, keepdims=True)
            top = z.max(1)
            e = np.exp(z - top[:, None])
            total = e.sum(1)
            # Others only add to the sum, so a prompt at or below ``least`` here stays there.
            maybe = (e > least * total[:, None]) & named
            rows = [[{"label": labels[j], "dim": dims[j], "z": float(z[i, j])} for j in np.flatnonzero(maybe[i])] for i in range(len(z))]
            yield pa.RecordBatch.from_arrays([part.column("case_id"), part.column("frame"), pa.array(top), pa.array(total), pa.array(rows, pa.list_(pa.struct([("label", pa.string()), ("dim", pa.string()), ("z", pa.float64())])))], ["case_id", "frame", "top", "total", "maybe"])


def image_labels(frames: DataFrame, prompts: DataFrame, least: float = config.VISION_LEAST, most: int = config.VISION_MOST) -> DataFrame:
    """Zero-shot labels: softmax over prompts of 100 * cosine per frame; labels with a dimension and p above ``least``, the best ``most`` per case.

    ``prompts``: label, dim, vector; any number of them.  A frame is multiplied with PROMPTS_AT_ONCE of them as a matrix; with more there are several passes, whose partial sums are put
    together per frame.  Of a frame and pass at most 1 / ``least`` labels go on.
    """
    spark = frames.sparkSession
    good = frames.where("embedding is not null and exists(embedding, x -> x <> 0)").select("case_id", "frame", "embedding")
    rows = prompts.select("label", "dim", "vector")
    n = rows.count()
    kind = _schema(good, "embedding", "top double, total double, maybe array<struct<label:string,dim:string,z:double>>")
    if not n:
        return spark.createDataFrame([], kind).select("case_id", "frame", F.lit("").alias("label"), F.lit("").alias("dim"), F.lit(0.0).alias("p"))
    passes = -(-n // PROMPTS_AT_ONCE)

    def one(k: int) -> DataFrame:
        some = (rows if passes == 1 else rows.where(F.pmod(F.xxhash64("label"), F.lit(passes)) == k)).orderBy("label").collect()
        if not some:
            return spark.createDataFrame([], kind)
        labels, dims, vectors = [r["label"] for r in some], [r["dim"] for r in some], np.array([r["vector"] for r in some], float)
        return good.mapInArrow(lambda batches: _label(batches, labels, dims, vectors, least), kind)

    found = reduce(DataFrame.unionByName, map(one, range(passes)))
    if passes > 1:
        at = F.aggregate(F.collect_list(F.struct("top", "total")), F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total")), lambda a, x: F.struct(F.greatest(a["top"], x["top"]).alias("top"), (a["total"] * F.exp(a["top"] - F.greatest(a["top"], x["top"])) + x["total"] * F.exp(x["top"] - F.greatest(a["top"], x["top"]))).alias("total")))
        found = found.groupBy("case_id", "frame").agg(at.alias("s"), F.flatten(F.collect_list("maybe")).alias("maybe")).select("case_id", "frame", "s.top", "s.total", "maybe")
    p = found.select("case_id", "frame", "top", "total", F.explode("maybe").alias("x")).select("case_id", "frame", "x.label", "x.dim", (F.exp(F.col("x.z") - F.col("top")) / F.col("total")).alias("p"))
    best = Window.partitionBy("case_id").orderBy(F.desc("p"), "frame", "label")
    return p.where(F.col("p") > least).withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= most).select("case_id", "frame", "label", "dim", "p")
