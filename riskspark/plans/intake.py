"""Queries of intake, sinks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions import text as T
from riskspark.operators.features import char_gram_counts, text_ngrams
from riskspark.plans.base import ORACLES, query
from riskspark.sources import cases as C
from riskspark.sources import intake as I
from riskspark.sources.fixtures import with_

DEDUP = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


def joined(c: str) -> str:
    return f"array_to_string({c}, '|')"


@query("io1_read_posts", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return I.read_posts(t.spark, f"{t.sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


COERCED = r"list_filter(regexp_split_to_array(coalesce(tags, ''), '[,\s]+'), lambda x: x <> '')"


@query("io2_coerce_hashtags", with_("posts") + f"SELECT case_id, {joined(COERCED)} AS tags FROM posts")
def _(t):
    return t.posts.select("case_id", F.array_join(I.coerce_hashtags(F.col("tags")), "|").alias("tags"))


FORCED = "list_transform({0}, lambda x: '#' || regexp_replace(x, '^#+', ''))"


@query("io3_split_hashtags", with_("posts", parts="SELECT case_id, " + FORCED.format("list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: regexp_replace(x, '^#+', '') <> '')") + " AS l FROM posts") + f"SELECT case_id, {joined(DEDUP.format('l'))} AS tags FROM parts")
def _(t):
    return t.posts.select("case_id", F.array_join(I.split_hashtags(F.col("tags")), "|").alias("tags"))


VALID = "(" + ", ".join(f"'{p}'" for p in config.PLATFORMS) + ")"


@query("io4_make_posts", with_("posts") + f"SELECT case_id, CASE WHEN coalesce(trim(url), '') <> '' THEN 'url' ELSE 'text' END AS source_type, CASE WHEN platform IN {VALID} THEN platform END AS platform, coalesce(title, '') AS title, length(coalesce(description, '')) AS n, coalesce(url, '') AS url FROM posts")
def _(t):
    return I.make_posts(t.posts).select("case_id", "source_type", "platform", "title", F.length("description").alias("n"), "url")


HOST = r"lower(coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), url, ''))"
BY_HOST = " ".join(f"WHEN contains(h, '{p}') THEN '{n}'" for p, n in config.PLATFORM_HOSTS)


@query("io5_resolve_platform", with_("posts") + f"SELECT case_id, CASE WHEN platform IN {VALID} THEN platform {BY_HOST} ELSE 'Instagram' END AS platform FROM (SELECT *, {HOST} AS h FROM posts)")
def _(t):
    return t.posts.select("case_id", I.resolve_platform(F.col("platform"), F.col("url")).alias("platform"))


@query("io5_platform_of_pages", f"SELECT page_id, CASE {BY_HOST} ELSE 'Instagram' END AS platform FROM (SELECT *, {HOST} AS h FROM pages)")
def _(t):
    return t.pages.select("page_id", I.resolve_platform(F.lit(None).cast("string"), F.col("url")).alias("platform"))


SCRAPED = r"""list_filter(list_transform(regexp_split_to_array(concat_ws(' ', title, description, tags, provided_transcript), '[ \n\t\r]+'), lambda w: regexp_replace(w, '^[.,!?;:()\[\]{}"''«»]+|[.,!?;:()\[\]{}"''«»]+$', '', 'g')), lambda w: starts_with(w, '#') AND length(w) > 1)"""
TAGGED = f"SELECT case_id, CASE WHEN len(g) > 0 THEN {DEDUP.format('g')} ELSE {DEDUP.format('s')}[1:12] END AS l FROM (SELECT case_id, {FORCED.format(COERCED)} AS g, {SCRAPED} AS s FROM posts)"


@query("io6_resolve_hashtags", with_("posts", tagged=TAGGED) + f"SELECT case_id, {joined('l')} AS tags FROM tagged")
def _(t):
    return t.posts.select("case_id", F.array_join(I.resolve_hashtags(F.col("tags"), F.col("title"), F.col("description"), F.col("tags"), F.col("provided_transcript")), "|").alias("tags"))


@query("io7_resolve_title", with_("posts") + r"SELECT case_id, CASE WHEN trim(title) <> '' THEN trim(title) WHEN stem <> '' THEN stem ELSE 'Untitled' END AS title FROM (SELECT *, substr(trim(translate(regexp_replace(regexp_replace(coalesce(filename, ''), '^.*[/\\]', ''), '\.[^.]*$', ''), '_-', '  ')), 1, 80) AS stem FROM posts)")
def _(t):
    return t.posts.select("case_id", I.resolve_title(F.col("title"), F.col("filename")).alias("title"))


@query("io8_resolve_duration", with_("posts", "media", "segments", "ocr", "visual") + """SELECT p.case_id, coalesce(m.duration_s, s.x, f.x, 0) AS duration_s FROM posts p LEFT JOIN media m USING (case_id) LEFT JOIN (SELECT case_id, max(end_s) x FROM segments GROUP BY 1) s USING (case_id)
LEFT JOIN (SELECT case_id, max(time_s) x FROM (SELECT case_id, time_s FROM ocr UNION ALL SELECT case_id, time_s FROM visual) GROUP BY 1) f USING (case_id)""")
def _(t):
    return I.resolve_duration(t.posts, t.media, t.segments, t.ocr, t.visual)


@query("io9_assemble_transcripts", with_("posts", "segments") + """SELECT case_id, count(*) AS n_segments, string_agg(trim(text), ' ' ORDER BY start_s, seg_no) AS full_text FROM (SELECT case_id, seg_no, start_s, text FROM segments WHERE trim(text) <> ''
UNION ALL SELECT case_id, -1, 0, provided_transcript FROM posts WHERE trim(provided_transcript) <> '') GROUP BY 1""")
def _(t):
    return I.assemble_transcripts(t.segments, t.posts)


@query("io10_aggregate_ocr_words", with_("ocr", words="SELECT case_id, frame, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS word_no FROM ocr") + "SELECT case_id, frame, string_agg(word, ' ' ORDER BY word_no) AS text, round(least(100, greatest(0, avg(conf))), 6) AS confidence FROM (SELECT *, (word_no * 13 + frame) % 101 - 20 AS conf FROM words) WHERE conf > 0 GROUP BY 1, 2 HAVING length(string_agg(word, ' ' ORDER BY word_no)) >= 3")
def _(t):
    words = t.ocr.select("case_id", "frame", F.posexplode(F.split("text", " ")).alias("p", "word")).withColumn("word_no", F.col("p") + 1).withColumn("conf", (F.col("word_no") * 13 + F.col("frame")) % 101 - 20)
    return I.aggregate_ocr_words(words).withColumn("confidence", F.round("confidence", 6))


@query("io11_sampling_plan", with_("media") + "SELECT case_id, CAST(i AS INTEGER) AS i, round(i / rate, 6) AS time_s FROM (SELECT case_id, unnest(range(0, CAST(least(20, greatest(1, floor(d * rate))) AS BIGINT))) AS i, rate FROM (SELECT case_id, d, least(0.5, 20.0 / d) AS rate FROM (SELECT case_id, greatest(coalesce(duration_s, 0), 1)::DOUBLE AS d FROM media)))")
def _(t):
    return I.sampling_plan(t.media).withColumn("time_s", F.round("time_s", 6))


CASES = "SELECT doc_id AS id, lang AS title, CAST('2024-01-01' AS DATE) + CAST(doc_id % 28 AS INT) AS upload_date, CAST((n_chars * 7 + doc_id) % 101 AS INT) AS score, CAST(doc_id AS BIGINT) AS seq FROM documents"
UPDATES = "SELECT doc_id AS id, concat(lang, '-v2') AS title, CAST(CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST('2024-02-01' AS DATE) END AS DATE) AS upload_date, CAST(doc_id % 101 AS INT) AS score, CAST(1000000 + doc_id AS BIGINT) AS seq FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0"
UPSERTED = "SELECT * FROM (SELECT * FROM cases UNION ALL SELECT * FROM updates) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"
STORE = "WITH cases AS (" + CASES + "), updates AS (" + UPDATES + "), stored AS (" + UPSERTED + ")\n"


def _stored(t):
    docs = {"documents": t.documents}
    return C.upsert_cases(t.spark.sql(CASES.replace("documents", "{documents}"), **docs), t.spark.sql(UPDATES.replace("documents", "{documents}"), **docs))


@query("io12_upsert_cases", STORE + "SELECT id, title, score, seq FROM stored")
def _(t):
    return _stored(t).select("id", "title", "score", "seq")


@query("io13_created_key", STORE + "SELECT id, coalesce(CAST(upload_date AS VARCHAR), '') AS created FROM stored")
def _(t):
    return _stored(t).select("id", C.created_key(F.col("upload_date").cast("string"), F.lit(None).cast("string")).alias("created"))


@query("io14_list_cases", STORE + "SELECT id, title FROM stored ORDER BY coalesce(CAST(upload_date AS VARCHAR), '') DESC, seq DESC LIMIT 200")
def _(t):
    return C.list_cases(_stored(t).withColumn("created", C.created_key(F.col("upload_date").cast("string"), F.lit(None).cast("string"))), 200).select("id", "title")


@query("io15_get_case", STORE + "SELECT id, title, score FROM stored WHERE id = 35")
def _(t):
    return C.get_case(_stored(t), 35).select("id", "title", "score")


@query("io16_count_cases", STORE + "SELECT count(*) AS n FROM stored")
def _(t):
    return C.count_cases(_stored(t))


@query("io17_json_round_trip", STORE + "SELECT id, title, score FROM stored WHERE id % 9 <> 0")
def _(t):
    packed = C.pack_cases(_stored(t).select("id", "title", "score"))
    broken = packed.withColumn("payload", F.when(F.col("id") % 9 == 0, F.lit("{broken")).otherwise(F.col("payload")))
    return C.unpack_cases(broken, "id BIGINT, title STRING, score INT")


@query("io21_model_versions", "SELECT source AS model, max(doc_id) AS active, count(*) AS versions, CAST(arg_max(n_chars, doc_id) AS BIGINT) AS metric FROM documents GROUP BY 1")
def _(t):
    return C.active_versions(t.documents.select(F.col("source").alias("model"), F.col("doc_id").alias("version"), F.col("doc_id").alias("activated_at"), F.col("n_chars").alias("metric")))


def _versions(t):
    return t.documents.select(F.col("source").alias("model"), F.col("doc_id").alias("version"), F.col("doc_id").alias("activated_at"), F.col("n_chars").alias("metric"))


@query("io21_list_versions", "SELECT source AS model, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place, doc_id AS version FROM documents")
def _(t):
    return C.list_versions(_versions(t))


# Every model goes back to the version before its active one, if it has two.
@query("io21_roll_back", "SELECT model, coalesce(max(version) FILTER (place = 2), max(version)) AS active FROM (SELECT source AS model, doc_id AS version, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) GROUP BY 1")
def _(t):
    versions = _versions(t)
    older = C.list_versions(versions).where("place = 2")
    return C.active_versions(C.roll_back(versions, older, F.lit(1 << 60))).select("model", "active")


# ---- text functions -------------------------------------------------------------------------------------------------

P = with_("posts")


def simple(name, column, sql, prelude=P, source="posts"):
    """One computed column per post."""

    @query(name, prelude + f"SELECT case_id, {sql} AS v FROM {source}")
    def _(t):
        return getattr(t, source).select("case_id", column().alias("v"))


simple("tx1_all_text", lambda: F.sha2(T.all_text(F.col("title"), F.col("description"), F.col("tags"), F.col("provided_transcript")), 256), "sha256(concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(tags) <> '' THEN tags END, CASE WHEN trim(provided_transcript) <> '' THEN provided_transcript END))")
simple("tx2_meta_text", lambda: F.sha2(T.joined([F.col("title"), F.col("description"), F.col("tags")], " "), 256), "sha256(concat_ws(' ', CASE WHEN title <> '' THEN title END, CASE WHEN description <> '' THEN description END, CASE WHEN tags <> '' THEN tags END))")
KB = "translate(lower(trim({0})), 'ё', 'е')"
simple("tx3_kb_text", lambda: F.sha2(T.kb_text(F.col("description")), 256), f"sha256({KB.format('description')})")
simple("tx4_kb_handle", lambda: T.kb_handle(F.coalesce(F.col("url"), F.lit("@Some_Name/"))), "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + KB.format("coalesce(url, '@Some_Name/')") + r", '^https?://', ''), '^t\.me/', ''), '^telegram\.me/', ''), '^@', ''), '^/+|/+$', '', 'g')")
TAG = "regexp_replace(" + KB.format("x") + ", '^#+', '')"
simple("tx5_kb_tag", lambda: F.array_join(F.transform(I.coerce_hashtags(F.col("tags")), T.kb_tag), "|"), f"array_to_string(list_transform({COERCED}, lambda x: CASE WHEN replace({TAG}, '_', '') = '' THEN '' ELSE '#' || replace({TAG}, '_', '') END), '|')")
AROUND = r"trim(regexp_extract(substr(description, 1, p0 - 1), '[^.!?\n]*\z') || substr(description, p0, 5) || regexp_extract(substr(description, p0 + 5), '^[^.!?\n]*'))"
simple("tx6_sentence_around", lambda: T.sentence_around(F.col("description"), F.greatest(F.instr("description", "the"), F.lit(1)), F.lit(5)), f"CASE WHEN length({AROUND}) > 160 THEN rtrim(substr({AROUND}, 1, 160)) || '…' ELSE {AROUND} END", P, "posts")
ORACLES["tx6_sentence_around"] = ORACLES["tx6_sentence_around"].removesuffix("FROM posts") + "FROM (SELECT *, greatest(instr(description, 'the'), 1) AS p0 FROM posts)"
simple("tx7_clip", lambda: T.clip(F.col("description")), "CASE WHEN length(description) > 160 THEN rtrim(substr(description, 1, 160)) || '…' ELSE description END")
FLAT = r"trim(regexp_replace(coalesce(description, ''), '[ \t\n\r]+', ' ', 'g'))"
simple("tx8_quote", lambda: T.quote(F.col("description")), f"CASE WHEN {FLAT} = '' THEN '' WHEN length({FLAT}) > 160 THEN '«' || rtrim(substr({FLAT}, 1, 157)) || '…»' ELSE '«' || {FLAT} || '»' END")
SEC = "CAST(round_even(greatest((case_id - 100) * 2.5::DOUBLE, 0), 0) AS BIGINT)"


@query("tx9_clock", P + f"SELECT case_id, lpad(CAST({SEC} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({SEC} % 60 AS VARCHAR), 2, '0') AS long_form, CAST({SEC} // 60 AS VARCHAR) || ':' || lpad(CAST({SEC} % 60 AS VARCHAR), 2, '0') AS short_form FROM posts")
def _(t):
    s = (F.col("case_id") - 100) * 2.5
    return t.posts.select("case_id", T.clock(s).alias("long_form"), T.short_clock(s).alias("short_form"))


simple("tx10_clamp", lambda: T.clamp((F.col("case_id") % 300 - 50) / 2.0), "CAST(least(100, greatest(0, round_even((case_id % 300 - 50) / 2.0::DOUBLE, 0))) AS INTEGER)")
simple("tx11_risk_level", lambda: T.risk_level(F.col("case_id") % 1010 / 10.0), "CASE WHEN case_id % 1010 >= 880 THEN 'critical' WHEN case_id % 1010 >= 650 THEN 'high' WHEN case_id % 1010 >= 400 THEN 'medium' ELSE 'low' END")


@query("tx12_severity", P + "SELECT case_id, CASE WHEN c >= 85 THEN 'critical' WHEN c >= 65 THEN 'high' WHEN c >= 45 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN c >= 85 THEN 3 WHEN c >= 65 THEN 2 WHEN c >= 45 THEN 1 ELSE 0 END AS rank FROM (SELECT case_id, case_id % 101 AS c FROM posts)")
def _(t):
    c = F.col("case_id") % 101
    return t.posts.select("case_id", T.severity(c).alias("severity"), T.severity_rank(c).alias("rank"))


simple("tx13_nfkc_casefold", lambda: F.sha2(T.nfkc_casefold(F.col("description")), 256), "NULL")
del ORACLES["tx13_nfkc_casefold"]
simple("tx14_fold_lookalikes", lambda: F.sha2(T.fold_lookalikes(F.col("description")), 256), f"sha256(translate(lower(description), '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}'))")
#: NFKC and case folding as far as the given texts need it: a sharp s is two letters.
FOLD = "replace(lower(nfc_normalize(description)), 'ß', 'ss')"
#: Twice, as a match takes the letter that the next one begins with.
GAP = "([" + T.LETTERS + "])[\\s\\x1c-\\x1f.\\-_*·•|/\\\\\u200b\u200c\u200d\u2060]+([" + T.LETTERS + "])"
SKELETON = f"translate({FOLD}, '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}')"
for _ in range(2):
    SKELETON = f"regexp_replace({SKELETON}, '{GAP}', '\\1\\2', 'g')"
SKELETON = f"trim(regexp_replace({SKELETON}, '[^{T.LETTERS}]+', ' ', 'g'))"
simple("tx15_collapse_separators", lambda: F.sha2(T.skeleton(F.col("description")), 256), f"sha256({SKELETON})")
WORDS = f"regexp_extract_all({FOLD}, '([{T.WORD}]+)', 1)"
simple("tx16_words", lambda: F.sha2(F.array_join(T.folded_words(F.col("description")), " "), 256), f"sha256(array_to_string({WORDS}, ' '))")


GRAMS = f"""toks AS (SELECT case_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT case_id, {WORDS} AS w FROM posts)),
grams AS (SELECT case_id, w AS gram, pos, 1 AS weight FROM toks UNION ALL SELECT case_id, w || ' ' || nxt, 100000000 + pos, 2 FROM (SELECT *, lead(w) OVER (PARTITION BY case_id ORDER BY pos) AS nxt FROM toks) WHERE nxt IS NOT NULL)
"""


@query("tx17_word_ngrams", P.rstrip() + ",\n" + GRAMS + "SELECT gram, count(*) AS n FROM grams GROUP BY 1")
def _(t):
    tokens = t.posts.select(T.folded_words(F.col("description")).alias("w"))
    return tokens.select(F.explode(T.word_ngrams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


#: Character grams of the words of a skeleton, with a space at both ends of a word.
INNER = f"""bones AS (SELECT case_id, string_split({SKELETON}, ' ') AS b FROM posts), bone AS (SELECT case_id, unnest(b) AS w, generate_subscripts(b, 1) AS pos FROM bones),
padded AS (SELECT case_id, ' ' || w || ' ' AS w, pos FROM bone WHERE w <> ''), sized AS (SELECT case_id, w, pos, unnest([3, 4, 5]) AS n FROM padded),
cut AS (SELECT case_id, w, pos, n, unnest(range(1, length(w) - n + 2)) AS k FROM sized WHERE length(w) >= n)
"""


@query("tx18_char_ngrams", P.rstrip() + ",\n" + INNER + "SELECT substr(w, k, n) AS gram, count(*) AS n FROM cut GROUP BY 1")
def _(t):
    return char_gram_counts(t.posts.select(T.skeleton(F.col("description")).alias("s")))


COUNT = "len(regexp_extract_all({0}, '{1}'))"
LOW = "lower(coalesce(description, ''))"
HINT = f"(SELECT case_id, {COUNT.format(LOW, '[а-яё' + T.KAZAKH + ']')} AS c, {COUNT.format(LOW, '[a-z]')} AS l, {COUNT.format(LOW, '[' + T.KAZAKH + ']')} AS k FROM posts)"


@query("tx19_language_hint", P + f"SELECT case_id, CASE WHEN c + l = 0 THEN '' WHEN k > 0 AND c / (c + l)::DOUBLE > 0.3 THEN 'kz' WHEN c / (c + l)::DOUBLE > 0.25 AND c / (c + l)::DOUBLE < 0.75 THEN 'mixed' WHEN c / (c + l)::DOUBLE >= 0.75 THEN 'ru' ELSE 'en' END AS hint FROM {HINT}")
def _(t):
    return t.posts.select("case_id", T.language_hint(F.col("description")).alias("hint"))


simple("tx20_obfuscated", lambda: T.looks_obfuscated(F.col("description")), "regexp_matches(coalesce(description, ''), '[​‌‍﻿]') OR regexp_matches(coalesce(description, ''), '(?i)([а-яёa-z][ \\t\\n\\r.\\-_]){3,}[а-яёa-z]') OR (regexp_matches(coalesce(description, ''), '(?i)[а-яё]') AND regexp_matches(coalesce(description, ''), '[aeopcxykmhtbAEOPCXYKMHTB]')) OR regexp_matches(coalesce(description, ''), '(?i)[а-яёa-z][013456780][а-яёa-z]')")


@query("tx21_numeric_text", P + "SELECT case_id, round(CASE WHEN length(description) > 0 THEN len(regexp_extract_all(description, '[0-9]')) / length(description)::DOUBLE ELSE 0 END, 9) AS digits, round(least(len(regexp_extract_all(description, '[\U0001f300-\U0001faff☀-➿​‌‍]')), 20) / 20.0::DOUBLE, 6) AS emoji, round(least(ln(1 + length(description)) / ln(2001::DOUBLE), 1), 6) AS size FROM posts")
def _(t):
    d = F.col("description")
    return t.posts.select("case_id", F.round(T.digit_ratio(d), 9).alias("digits"), F.round(T.emoji_share(d), 6).alias("emoji"), F.round(T.log_length(d), 6).alias("size"))


#: Plain phrases of the dimension profit, folded as the texts are.
ANCHORS = tuple(r[1].lower().translate(str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)) for r in config.LEXICON if r[0] == "profit" and not r[3] and len(r[1]) >= 4)
FOLDED = f"translate({LOW}, '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}')"


@query("tx22_anchor_density", P + "SELECT case_id, least(" + " + ".join(f"(length({FOLDED}) - length(replace({FOLDED}, '{a}', ''))) // {len(a)}" for a in ANCHORS) + ", 5) / 5.0::DOUBLE AS v FROM posts")
def _(t):
    return t.posts.select("case_id", T.anchor_density(F.coalesce("description", F.lit("")), ANCHORS).alias("v"))


TAG_ANCHORS = ("заработок", "казино", "easymoney", "invest")
BARE = f"list_transform({COERCED}, lambda x: replace(lower(x), '#', ''))"
IS_BAD = "x <> '' AND (" + " OR ".join(f"contains(x, '{a}') OR contains('{a}', x)" for a in TAG_ANCHORS) + ")"


@query("tx23_suspicious_tags", P + f"SELECT case_id, CASE WHEN len({COERCED}) > 0 THEN len(list_filter({BARE}, lambda x: {IS_BAD})) / len({COERCED})::DOUBLE ELSE 0 END AS v FROM posts")
def _(t):
    return t.posts.select("case_id", T.suspicious_tags(I.coerce_hashtags(F.col("tags")), TAG_ANCHORS).alias("v"))


WEIGHED = "weighed AS (SELECT case_id, gram, pos::BIGINT AS pos, weight FROM grams UNION ALL SELECT case_id, trim(substr(w, k, n)), (1000000000 + pos::BIGINT) * 1000000000 + n * 100000000 + k, 1 FROM cut)\n"


@query("tx24_top_ngrams", P.rstrip() + ",\n" + GRAMS.rstrip() + ", " + INNER.rstrip() + ", " + WEIGHED + "SELECT case_id, gram, n::BIGINT AS n FROM (SELECT case_id, gram, sum(weight) AS n, min(pos) AS pos FROM weighed GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, pos) <= 5")
def _(t):
    return text_ngrams(t.posts.select("case_id", F.col("description").alias("text")), 5)


simple("tx27_date", lambda: F.date_format("created", "dd.MM.yyyy"), "strftime(created, '%d.%m.%Y')")
