"""Timelines and evidence cards of cases."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.text import clamp, clock, quote, severity, severity_rank


def candidates(hits: DataFrame, images: DataFrame) -> DataFrame:
    """``case_id, time_s, source, signal, confidence``: timed hits and image labels with text."""
    timed = hits.where("time_s is not null and trim(signal) <> ''").select("case_id", "time_s", "source", "signal", "confidence")
    shown = images.where("trim(label) <> ''").select("case_id", "time_s", F.lit("Visual").alias("source"), F.col("label").alias("signal"), (F.col("score") * 100).alias("confidence"))
    return timed.unionByName(shown)


class Fold:
    """Kept events of one case and source, fed in time order.

    An event falls in with the first kept one (by when it was first kept) that is at most ``window`` seconds away or says the same; the stronger of the two
    stays at that place.  Kept events are found by their lower-cased signal and, as times rise, by a heap of those near enough (one that is too far by now stays so until it is anchored anew), so an
    event costs a few steps of a heap however many are kept.  What is held are the kept events: not more than there are different signals.
    """

    def __init__(self, window: float):
        self.window, self.kept = window, []
        self.by_signal: dict[str, list[int]] = {}
        self.near: list[int] = []

    def _note(self, k: int) -> None:
        time_s, signal, _ = self.kept[k]
        heapq.heappush(self.by_signal.setdefault(signal.lower(), []), k)
        heapq.heappush(self.near, k)

    def _first(self, heap: list[int], holds: Callable[[int], bool]) -> int | None:
        while heap and not holds(heap[0]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def add(self, time_s: float, signal: str, confidence: float) -> None:
        low = signal.lower()
        said = self._first(self.by_signal.get(low, []), lambda k: self.kept[k][1].lower() == low)
        close = self._first(self.near, lambda k: time_s - self.kept[k][0] <= self.window)
        found = [k for k in (said, close) if k is not None]
        if not found:
            self.kept.append((time_s, signal, confidence))
            self._note(len(self.kept) - 1)
            return
        k = min(found)
        if strength(confidence) > strength(self.kept[k][2]):
            self.kept[k] = (time_s, signal, confidence)
            self._note(k)


def strength(confidence: float) -> tuple[int, float]:
    """What is compared between two events that are the same: severity, then confidence."""
    return sum(confidence >= least for _, least in config.SEVERITIES), confidence


def _dedup(batches: Iterable[pa.RecordBatch], window: float) -> Iterator[pa.RecordBatch]:
    """Kept events of each case and source; their rows come one after the other, by time."""
    key, fold = None, None

    def kept() -> Iterator[pa.RecordBatch]:
        for a in range(0, len(fold.kept), 8192):
            part = fold.kept[a : a + 8192]
            columns = [pa.array([key[0]] * len(part), cases), pa.array([e[0] for e in part], pa.float64()), pa.array([key[1]] * len(part), pa.string()), pa.array([e[1] for e in part], pa.string()), pa.array([e[2] for e in part], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["case_id", "time_s", "source", "signal", "confidence"])

    for batch in batches:
        cases = batch.column("case_id").type
        for case, source, *event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if fold is None or (case, source) != key:
                if fold is not None:
                    yield from kept()
                key, fold = (case, source), Fold(window)
            fold.add(*event)
    if fold is not None:
        yield from kept()


def dedup(events: DataFrame, window: float = config.TIMELINE_WINDOW) -> DataFrame:
    """Greedy, in time order: an event falls in with the first kept one of its source that is at most ``window`` seconds away or says the same.

    The stronger of the two stays (by severity, then confidence) and its time is the new anchor.  Later events depend on that choice, so the events of a case and source are a sequence:
    they are sorted within partitions and streamed through ``Fold``, which holds the kept ones only, and results come out as a sequence ends.
    Ties of time go by signal, then confidence.  Events without a time are left out.
    """
    names = ("case_id", "source", "time_s", "signal", "confidence")
    rows = events.where("time_s is not null").select("case_id", "source", "time_s", F.coalesce("signal", F.lit("")).alias("signal"), F.col("confidence").cast("double").alias("confidence"))
    kind = rows.schema["case_id"].dataType.simpleString()
    ordered = rows.repartition("case_id", "source").sortWithinPartitions(*names)
    return ordered.mapInArrow(lambda batches: _dedup(batches, window), f"case_id {kind}, time_s double, source string, signal string, confidence double")


def build_timeline(events: DataFrame, most: int = config.TIMELINE_MOST) -> DataFrame:
    """The ``most`` severest events back in time order, numbered, with clock and severity."""
    strong = Window.partitionBy("case_id").orderBy(F.desc(severity_rank(F.col("confidence"))), F.desc("confidence"), "time_s", "source", "signal")
    kept = events.withColumn("__k", F.row_number().over(strong)).where(F.col("__k") <= most)
    by_time = Window.partitionBy("case_id").orderBy("time_s", "source", "signal")
    confidence = clamp(F.col("confidence"))
    return kept.select("case_id", F.concat(F.lit("t"), F.row_number().over(by_time)).alias("id"), clock(F.col("time_s")).alias("time"), "source", "signal", confidence.alias("confidence"), severity(confidence).alias("severity"))


def findings(hits: DataFrame, extras: DataFrame | None = None, most: int = config.FINDINGS_MOST) -> DataFrame:
    """``case_id, findings``: extra tags, then chips in hit order, each once whatever its case, ``most`` at most, joined by |."""
    rows = hits.select("case_id", F.lit(1).alias("g"), "lane", "seg_no", "rule_ord", "pos", F.trim("chip").alias("chip"))
    if extras is not None:
        more = extras.select("case_id", F.posexplode("tags").alias("n", "chip")).select("case_id", F.lit(0).alias("g"), F.lit(0).alias("lane"), F.lit(0).cast("long").alias("seg_no"), F.lit(0).alias("rule_ord"), F.col("n").alias("pos"), F.trim("chip").alias("chip"))
        rows = rows.unionByName(more)
    order = F.struct("g", "lane", "seg_no", "rule_ord", "pos", "chip")
    once = rows.where("chip <> ''").groupBy("case_id", F.lower("chip").alias("low")).agg(F.min(order).alias("o"))
    first = Window.partitionBy("case_id").orderBy("o")
    kept = once.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    return kept.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("o.chip").alias("chip")))), lambda x: x["chip"]), "|").alias("findings"))


def hit_card(hits: DataFrame, source: str, kind: str, extras: DataFrame | None = None) -> DataFrame:
    """``case_id, type, confidence, fragment, findings`` from the hits of one source; the strongest hit is quoted, first on ties."""
    own = hits.where((F.col("source") == source) & (F.col("dim") != "negative"))
    order = F.struct("confidence", *[(-F.col(c)).alias(c) for c in ("lane", "seg_no", "rule_ord", "pos")], "signal")
    best = own.groupBy("case_id").agg(F.max("confidence").alias("confidence"), F.max_by(F.coalesce(F.nullif(F.trim("fragment"), F.lit("")), F.col("signal")), order).alias("best"))
    listed = findings(own, None if extras is None else extras.join(own.select("case_id").distinct(), "case_id", "left_semi"))
    return best.join(listed, "case_id", "left").select("case_id", F.lit(kind).alias("type"), clamp(F.col("confidence")).alias("confidence"), quote(F.col("best")).alias("fragment"), F.coalesce("findings", F.lit("")).alias("findings"))


def with_fallback(cards: DataFrame, other: DataFrame) -> DataFrame:
    """Cards, and those of ``other`` for cases without one."""
    return cards.unionByName(other.join(cards.select("case_id"), "case_id", "left_anti"))


def speech_card(hits: DataFrame, transcripts: DataFrame) -> DataFrame:
    plain = transcripts.where("trim(full_text) <> ''").select("case_id", F.lit("audio").alias("type"), F.lit(40).alias("confidence"), quote(F.col("full_text")).alias("fragment"), F.lit("").alias("findings"))
    return with_fallback(hit_card(hits, "Audio", "audio"), plain)


def screen_card(hits: DataFrame, ocr: DataFrame) -> DataFrame:
    best = ocr.groupBy("case_id").agg(F.max("confidence").alias("confidence"), F.max_by("text", F.struct("confidence", -F.col("frame"))).alias("best"))
    plain = best.select("case_id", F.lit("ocr").alias("type"), clamp(F.col("confidence")).alias("confidence"), quote(F.col("best")).alias("fragment"), F.lit("").alias("findings"))
    return with_fallback(hit_card(hits, "OCR", "ocr"), plain)


def image_card(images: DataFrame, most: int = config.FINDINGS_MOST) -> DataFrame:
    """Best label quoted; up to ``most`` different labels by score."""
    labels = images.where("trim(label) <> ''").groupBy("case_id", "label").agg(F.max("score").alias("score"))
    k = Window.partitionBy("case_id").orderBy(F.desc("score"), "label")
    ranked = labels.withColumn("k", F.row_number().over(k)).where(F.col("k") <= most)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"])
    return ranked.groupBy("case_id").agg(F.lit("visual").alias("type"), clamp(F.max("score") * 100).alias("confidence"), quote(joined[0]).alias("fragment"), F.array_join(joined, "|").alias("findings"))


def link_card(links: DataFrame, hits: DataFrame) -> DataFrame:
    """Different values joined; confidence of the strongest messenger or referral hit, else 70."""
    order = F.array_sort(F.collect_list(F.struct("place", "kind_ord", "at", "value")))
    values = links.groupBy("case_id").agg(F.array_distinct(F.transform(order, lambda x: x["value"])).alias("values"))
    near = hits.where("dim in ('messenger', 'referral')").groupBy("case_id").agg(F.max("confidence").alias("c"))
    return values.join(near, "case_id", "left").select("case_id", F.lit("links").alias("type"), clamp(F.coalesce("c", F.lit(70.0))).alias("confidence"), quote(F.array_join("values", "; ")).alias("fragment"), F.array_join(F.slice("values", 1, config.FINDINGS_MOST), "|").alias("findings"))
