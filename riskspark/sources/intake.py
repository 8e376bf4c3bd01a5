"""Intake: reading posts and filling what they lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import config

DOCUMENT_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def read_posts(spark: SparkSession, path: str, schema: str = DOCUMENT_SCHEMA, kind: str = "parquet") -> DataFrame:
    """Posts with a fixed schema; nothing is inferred."""
    return spark.read.schema(schema).format(kind).load(path)


def coerce_hashtags(c: Column) -> Column:
    """A comma or space separated string as an array, empty items dropped."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,\s]+"), lambda x: x != "")


def first_of_each(c: Column) -> Column:
    """The array without later items that differ from an earlier one in case only."""
    low = F.transform(c, F.lower)
    return F.filter(c, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)


def forced(c: Column) -> Column:
    return F.transform(c, lambda x: F.concat(F.lit("#"), F.regexp_replace(x, "^#+", "")))


def split_hashtags(c: Column) -> Column:
    """Comma separated tags, trimmed, with ``#``, each once whatever its case."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: F.regexp_replace(x, "^#+", "") != "")
    return first_of_each(forced(parts))


def make_posts(posts: DataFrame) -> DataFrame:
    """``source_type`` by url, an unknown platform as null, null texts as empty."""
    url = F.coalesce(F.trim("url"), F.lit(""))
    return posts.withColumns({
        "source_type": F.when(url != "", "url").otherwise("text"),
        "platform": F.when(F.col("platform").isin(*config.PLATFORMS), F.col("platform")),
        **{c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "url")},
    })


def resolve_platform(platform: Column, url: Column) -> Column:
    """A valid platform as given, else by the first part that the host (or bare url) contains, else Instagram."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), url, F.lit("")))
    out = F.when(platform.isin(*config.PLATFORMS), platform)
    for part, name in config.PLATFORM_HOSTS:
        out = out.when(host.contains(part), name)
    return out.otherwise("Instagram")


def resolve_hashtags(tags: Column, *texts: Column) -> Column:
    """Given tags, or the first 12 ``#words`` of the texts; punctuation, brackets and quotes around a word are taken off first."""
    given = first_of_each(forced(coerce_hashtags(tags)))
    text = F.concat_ws(" ", *texts)
    bare = F.transform(F.split(text, r"[ \n\t\r]+"), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]{}\"'«»]+|[.,!?;:()\[\]{}\"'«»]+$", ""))
    scraped = F.slice(first_of_each(F.filter(bare, lambda w: w.startswith("#") & (F.length(w) > 1))), 1, 12)
    return F.when(F.size(given) > 0, given).otherwise(scraped)


def resolve_title(title: Column, filename: Column) -> Column:
    """The title, else the file's name without path and ending, else a constant."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(filename, F.lit("")), r"^.*[/\\]", ""), r"\.[^.]*$", "")
    named = F.substring(F.trim(F.translate(stem, "_-", "  ")), 1, 80)
    return F.when(F.trim(title) != "", F.trim(title)).when(named != "", named).otherwise("Untitled")


def resolve_duration(posts: DataFrame, media: DataFrame, segments: DataFrame, ocr: DataFrame, visual: DataFrame) -> DataFrame:
    """``case_id, duration_s``: probe, else last segment end, else last frame, else 0. Each side is one partial aggregate."""
    spoken = segments.groupBy("case_id").agg(F.max("end_s").alias("spoken"))
    frames = ocr.select("case_id", "time_s").unionByName(visual.select("case_id", "time_s")).groupBy("case_id").agg(F.max("time_s").alias("shown"))
    return posts.select("case_id").join(media, "case_id", "left").join(spoken, "case_id", "left").join(frames, "case_id", "left").select("case_id", F.coalesce("duration_s", "spoken", "shown", F.lit(0.0)).alias("duration_s"))


def assemble_transcripts(segments: DataFrame, posts: DataFrame) -> DataFrame:
    """``case_id, n_segments, full_text``: non-blank segments in order; a supplied transcript is one segment at 0 s and goes first."""
    given = posts.where(F.trim("provided_transcript") != "").select("case_id", F.lit(-1).cast("long").alias("seg_no"), F.lit(0.0).alias("start_s"), F.col("provided_transcript").alias("text"))
    rows = segments.where(F.trim("text") != "").select("case_id", "seg_no", "start_s", "text").unionByName(given)
    ordered = F.array_sort(F.collect_list(F.struct("start_s", "seg_no", F.trim("text").alias("text"))))
    return rows.groupBy("case_id").agg(F.count("*").alias("n_segments"), F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("full_text"))


def aggregate_ocr_words(words: DataFrame) -> DataFrame:
    """``case_id, frame, text, confidence`` from word rows: confident words in order, at least 3 characters, clamped mean."""
    ordered = F.array_sort(F.collect_list(F.struct("word_no", "word")))
    found = words.where(F.col("conf") > 0).groupBy("case_id", "frame").agg(F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.avg("conf"))).alias("confidence"))
    return found.where(F.length("text") >= 3)


def sampling_plan(media: DataFrame, interval: float = 2.0, most: int = 20) -> DataFrame:
    """``case_id, i, time_s``: samples every ``interval`` seconds, spread wider where ``most`` would be exceeded."""
    length = F.greatest(F.coalesce("duration_s", F.lit(0.0)), F.lit(1.0))
    rate = F.least(F.lit(1.0 / interval), F.lit(float(most)) / length)
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(length * rate).cast("int")))
    return media.withColumn("rate", rate).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select("case_id", "i", (F.col("i") / F.col("rate")).alias("time_s"))
