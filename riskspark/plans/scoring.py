"""Queries of matching, scoring and the whole pipeline."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions import text as T
from riskspark.operators import features as X
from riskspark.operators import match as M
from riskspark.operators import score as S
from riskspark.plans.base import Inputs, query
from riskspark.session import materialise, shared_folder
from riskspark.sources import intake as I
from riskspark.sources.fixtures import SQL, _text, values, with_
from riskspark.streaming.rescore import ARRIVAL, CaseStore

# ---- the same steps in DuckDB SQL ------------------------------------------------------------------------------------
SENTENCE = r"trim(regexp_extract(substr(text, 1, pos - 1), '[^.!?\n]*\z') || substr(text, pos, size) || regexp_extract(substr(text, pos + size), '^[^.!?\n]*'))"


def matches(texts: str, rules: str) -> str:
    """Every occurrence of every rule."""
    return f"""SELECT *, CASE WHEN length(sent) > 160 THEN rtrim(substr(sent, 1, 160)) || '…' ELSE sent END AS fragment FROM (SELECT *, {SENTENCE} AS sent FROM (
 SELECT *, length(matched) AS size, coalesce(nullif(label, ''), lower(trim(CASE WHEN is_regex THEN matched ELSE pattern END))) AS chip FROM (
 SELECT * EXCLUDE (ms, gs), unnest(ms) AS matched, unnest(list_transform(range(1, len(ms) + 1), lambda i: 1 + coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)))::INTEGER AS pos
 FROM (SELECT *, regexp_extract_all(text, p) AS ms, string_split_regex(text, p) AS gs FROM (SELECT t.*, r.*, '(?i)' || CASE WHEN is_regex THEN pattern ELSE regexp_escape(pattern) END AS p FROM {texts} t CROSS JOIN {rules} r) WHERE regexp_matches(text, p))) WHERE matched <> ''))"""


def hit_rows(kind: str, keys: str, order: str, **columns: str) -> str:
    c = {"lane": "1", "source": "'Metadata'", "confidence": "weight::DOUBLE", "signal": "chip", "fragment": "fragment", "time_s": "time_s", "chip": "chip"} | columns
    return f"SELECT case_id, {c['lane']} AS lane, {c['source']} AS source, place AS seg_no, rule_ord, pos, {c['confidence']} AS confidence, {c['signal']} AS signal, {c['fragment']} AS fragment, {c['time_s']} AS time_s, dim, {c['chip']} AS chip FROM (SELECT * FROM found WHERE kind = '{kind}' QUALIFY row_number() OVER (PARTITION BY case_id, {keys} ORDER BY {order}) = 1)"


META = "SELECT case_id, 0 AS seg_no, CAST(NULL AS DOUBLE) AS time_s, concat_ws(chr(10), CASE WHEN title <> '' THEN title END, CASE WHEN description <> '' THEN description END, CASE WHEN tags <> '' THEN tags END) AS text FROM posts"
SPEECH = "SELECT case_id, seg_no, start_s AS time_s, text FROM segments WHERE trim(text) <> ''"
SCREEN = "SELECT case_id, frame AS seg_no, time_s, text FROM ocr"
CALL_RULES = "SELECT * FROM " + values([(k, d, p, w, True, tag, s) for k, (p, w, s, d, tag) in enumerate(config.CALLS)], "ord, dim, pattern, weight, is_regex, label, signal")
RULES = "SELECT ord, ord AS rule_ord, 'phrase' AS kind, dim, pattern, weight, is_regex, label, '' AS signal, '' AS tag FROM lexicon UNION ALL SELECT ord + 1000000, ord, 'negative', 'negative', pattern, weight, FALSE, '', '', '' FROM negatives UNION ALL SELECT ord + 2000000, ord, 'call', dim, pattern, weight, is_regex, '', signal, label FROM calls"
CLIP = lambda x: f"CASE WHEN length({x}) > 160 THEN rtrim(substr({x}, 1, 160)) || '…' ELSE {x} END"
TEXTS = " UNION ALL ".join(f"SELECT case_id, {k} AS source_ord, '{field}' AS source_field, {k * M.PLACE} + seg_no AS place, time_s, text FROM {table}" for k, (field, table) in enumerate((("description", "meta"), ("transcript", "speech"), ("ocr", "screen"))))
PHRASE_HITS = hit_rows("phrase", "source_ord, dim, chip", "place, rule_ord, pos", source="CASE source_ord WHEN 0 THEN 'Metadata' WHEN 1 THEN 'Audio' ELSE 'OCR' END")
NEG_HITS = hit_rows("negative", "chip", "place, rule_ord, pos", time_s="CAST(NULL AS DOUBLE)")
CALL_HITS = hit_rows("call", "tag, lower(trim(matched))", "rule_ord, place, pos", lane="2", source="'Behavior'", signal="signal", fragment=CLIP("trim(matched)"), chip="tag", time_s="(SELECT min(x.time_s) FROM (SELECT case_id AS c, time_s, text FROM speech UNION ALL SELECT case_id, time_s, text FROM screen) x WHERE x.c = case_id AND contains(lower(x.text), lower(trim(matched))))")
LINK_ROWS = " UNION ALL ".join(f"SELECT case_id, source_field, place, {k} AS kind_ord, '{kind}' AS kind, unnest(l) AS value, generate_subscripts(l, 1) AS at0 FROM (SELECT *, regexp_extract_all(text, '(?i){regex.replace(chr(39), chr(39) * 2)}', 1) AS l FROM texts)" for k, (kind, regex, *_) in enumerate(config.LINKS))
LINKS = rf"SELECT * FROM (SELECT * REPLACE (regexp_replace(value, '^\s+|\s+$', '', 'g') AS value) FROM ({LINK_ROWS})) WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY case_id, kind, lower(value) ORDER BY place, at0) = 1"
KIND = lambda at: "CASE kind " + " ".join(f"WHEN '{x[0]}' THEN {_text(x[at])}" for x in config.LINKS) + " END"
LINK_HITS = f"SELECT case_id, 0 AS lane, 'Metadata' AS source, place AS seg_no, kind_ord AS rule_ord, at0 AS pos, ({KIND(3)})::DOUBLE AS confidence, {KIND(4)} || ': ' || value AS signal, value AS fragment, CAST(NULL AS DOUBLE) AS time_s, {KIND(2)} AS dim, value AS chip FROM links"
FUNNEL_HITS = f"SELECT case_id, 2 AS lane, 'Behavior' AS source, place AS seg_no, 100 + kind_ord AS rule_ord, at0 AS pos, f.confidence::DOUBLE AS confidence, f.signal || ': ' || value AS signal, {CLIP('value')} AS fragment, CAST(NULL AS DOUBLE) AS time_s, f.dim, value AS chip FROM links JOIN funnel f USING (kind)"
HITS = " UNION ALL ".join(f"SELECT * FROM {x}" for x in ("link_hits", "phrase_hits", "neg_hits", "funnel_hits", "call_hits"))
FOLD = "100 * (1 - product(1 - least(greatest({0}, 0), 100) / 100))"
DIM_ROWS = f"SELECT p.case_id, d.dim_no, d.dim, CAST(least(100, greatest(0, round_even(coalesce(x, 0), 0))) AS INTEGER) AS value FROM posts p CROSS JOIN dims d LEFT JOIN (SELECT case_id, dim, round({FOLD.format('confidence')}, 9) AS x FROM (SELECT case_id, dim, confidence FROM hits WHERE dim <> 'negative' UNION ALL SELECT case_id, dim, score * 100 FROM visual WHERE dim <> '') GROUP BY 1, 2) s USING (case_id, dim)"
KB_ROWS = [(k, c, "|".join(h), "|".join(t), "|".join(w), n, d) for k, (c, d, n, h, t, w, _) in enumerate(config.CLUSTERS)]
CLUSTERS = "SELECT ord, cluster, string_split(h, '|') AS handles, string_split(g, '|') AS tags, string_split(w, '|') AS keywords, size FROM " + values([r[:6] for r in KB_ROWS], "ord, cluster, h, g, w, size")
KBN = "translate(lower(trim({0})), 'ё', 'е')"
PRINTS = f"""SELECT p.case_id, {KBN.format("concat_ws(' ', title, description, tags)")} AS text, list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, description, tags)), '[ ,\\n\\t\\r]+'), lambda w: starts_with(w, '#')), lambda w: CASE WHEN replace(regexp_replace(w, '^#+', ''), '_', '') = '' THEN '' ELSE '#' || replace(regexp_replace({KBN.format('w')}, '^#+', ''), '_', '') END), lambda x: x <> '')) AS tags, coalesce(h.handles, []) AS handles
 FROM posts p LEFT JOIN (SELECT case_id, list(DISTINCT lower(value)) AS handles FROM links WHERE kind = 'telegram' GROUP BY 1) h USING (case_id)"""
JACCARD = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0)::DOUBLE, 0)"
KB_ALL = f"SELECT case_id, cluster, ord, round(0.45::DOUBLE * {JACCARD.format('p.handles', 'c.handles')} + 0.30::DOUBLE * {JACCARD.format('p.tags', 'c.tags')} + 0.25::DOUBLE * (len(list_filter(keywords, lambda k: contains(p.text, k))) / len(keywords)::DOUBLE), 9) AS raw FROM prints p CROSS JOIN clusters c"
KB = "SELECT case_id, CASE WHEN raw >= 0.04 THEN cluster ELSE 'isolated' END AS cluster, raw, CASE WHEN raw >= 0.04 THEN CAST(least(100, round_even(raw * 130, 0)) AS INTEGER) ELSE 0 END AS kb_score FROM (SELECT * FROM kb_all QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY raw DESC, ord) = 1)"
BOOSTED = "SELECT d.case_id, dim_no, dim, CASE WHEN dim = 'reused' THEN greatest(value, coalesce(kb_score, 0)) ELSE value END AS value FROM dim_rows d LEFT JOIN kb USING (case_id)"
WIDE = "SELECT case_id, " + ", ".join(f"max(CASE WHEN dim = '{d}' THEN value END)::DOUBLE AS {d}" for d in config.DIMENSIONS) + " FROM boosted GROUP BY 1"


def fold_sql(*xs: str) -> str:
    out, ordered = "0::DOUBLE", [f"list_reverse_sort([{', '.join(xs)}])[{k + 1}]" for k in range(len(xs))]
    for x in ordered:
        out = f"({out} + {x} * (1 - {out} / 100))" if out != "0::DOUBLE" else x
    return out


NEG = f"SELECT case_id, round({FOLD.format('confidence')}, 9) AS neg FROM hits WHERE dim = 'negative' GROUP BY 1"
PARTS = f"""SELECT *, {fold_sql('profit', '0.85::DOUBLE * urgency')} AS text_speech, {fold_sql('gambling', 'visual')} AS visual_part, {fold_sql('0.85::DOUBLE * hashtags', '0.8::DOUBLE * messenger')} AS metadata_links,
 {fold_sql('referral', '0.7::DOUBLE * urgency', '0.6::DOUBLE * messenger')} AS behavior, reused AS db_similarity FROM wide LEFT JOIN neg USING (case_id)"""
OVERALL = "SELECT *, CAST(least(100, greatest(0, round_even(overall, 0))) AS INTEGER) AS score, CASE WHEN overall >= 88 THEN 'critical' WHEN overall >= 65 THEN 'high' WHEN overall >= 40 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, (0.35::DOUBLE * text_speech + 0.25::DOUBLE * visual_part + 0.15::DOUBLE * metadata_links + 0.15::DOUBLE * behavior + 0.10::DOUBLE * db_similarity) * (1 - least(0.55::DOUBLE, coalesce(neg, 0) / 180)) AS overall FROM parts)"
TOP_DIM = "list_max([" + ", ".join(f"{{'v': {d}, 'n': {-n}, 'k': '{d}'}}" for n, d in enumerate(config.DIMENSIONS)) + "]).k"
BEST = "SELECT case_id, dim, coalesce(nullif(trim(fragment), ''), signal) AS best FROM hits QUALIFY row_number() OVER (PARTITION BY case_id, dim ORDER BY confidence DESC, lane, seg_no, rule_ord, pos, source DESC, signal DESC) = 1"
REASON = f"SELECT o.*, CASE WHEN overall < 40 THEN CASE WHEN coalesce(neg, 0) > 0 THEN 'warns of fraud' ELSE 'no clear signs' END WHEN b.best IS NOT NULL THEN o.top_dim || ': «' || b.best || '»' ELSE o.top_dim END AS reason FROM (SELECT *, {TOP_DIM} AS top_dim FROM overall) o LEFT JOIN best b ON b.case_id = o.case_id AND b.dim = o.top_dim"
RULE = lambda r: " AND ".join([*([f"{r[1]} >= {r[2]}"] if r[1] else []), *(["(" + " OR ".join(f"contains(low, '{w}')" for w in r[3]) + ")"] if r[3] else [])])
CATEGORY = "SELECT r.*, CASE " + " ".join(f"WHEN coalesce(neg, 0) >= 35 AND {RULE(r)} THEN '{r[0]}'" for r in config.CATEGORIES if r[4]) + " " + " ".join(f"WHEN {RULE(r)} THEN '{r[0]}'" for r in config.CATEGORIES) + " WHEN score < 40 THEN 'no_violation' ELSE 'suspicious_other' END AS category FROM reason r JOIN (SELECT case_id, lower(text) AS low FROM meta) USING (case_id)"
CHAIN = {
    **{n: SQL[n] for n in ("posts", "segments", "ocr", "visual", "lexicon", "negatives", "funnel", "dims")}, "meta": META, "speech": SPEECH, "screen": SCREEN, "calls": CALL_RULES, "rules": RULES, "texts": TEXTS, "found": matches("texts", "rules"),
    "phrase_hits": PHRASE_HITS, "neg_hits": NEG_HITS, "links": LINKS, "link_hits": LINK_HITS, "funnel_hits": FUNNEL_HITS, "call_hits": CALL_HITS, "hits": HITS, "dim_rows": DIM_ROWS, "clusters": CLUSTERS, "prints": PRINTS, "kb_all": KB_ALL, "kb": KB,
    "boosted": BOOSTED, "wide": WIDE, "neg": NEG, "parts": PARTS, "overall": OVERALL, "best": BEST, "reason": REASON, "category": CATEGORY,
}


def chain(body: str) -> str:
    return with_(**CHAIN) + body


# ---- Spark -----------------------------------------------------------------------------------------------------------
class Scored:
    """The steps of the pipeline over the fixtures, each a DataFrame."""

    def __init__(self, t: Inputs, only=None):
        """``only``: a table of the cases to score, as after a change of their inputs."""
        self.t, self.only = t, only
        self.meta = M.meta_text(t.posts)
        self.speech = t.segments.where(F.trim("text") != "").select("case_id", "seg_no", F.col("start_s").alias("time_s"), "text")
        self.screen = t.ocr.select("case_id", F.col("frame").alias("seg_no"), "time_s", "text")

    @property
    def texts(self):
        texts = M.all_texts(self.meta, self.speech, self.screen)
        return texts if self.only is None else texts.join(self.only, "case_id", "left_semi")

    @cached_property
    def found(self):
        rules = M.all_rules(self.t.lexicon, self.t.negatives, M.call_rules(self.t.spark))
        return materialise(M.find_matches(self.texts, rules, every=False))

    @cached_property
    def links(self):
        return materialise(M.extract_links(self.texts))

    @property
    def calls(self):
        return M.call_hits(self.found, self.speech.select("case_id", "time_s", "text").unionByName(self.screen.select("case_id", "time_s", "text")))

    @cached_property
    def hits(self):
        return materialise(M.all_hits(M.link_hits(self.links), M.scan(self.found), M.scan_negatives(self.found), M.funnel_hits(self.links, self.t.funnel), self.calls))

    @property
    def clusters(self):
        rows = [(k, c, list(h), list(g), list(w), n) for k, (c, _, n, h, g, w, _) in enumerate(config.CLUSTERS)]
        return self.t.spark.createDataFrame(rows, "ord int, cluster string, handles array<string>, tags array<string>, keywords array<string>, size int")

    @cached_property
    def kb(self):
        return S.kb_similarity(S.fingerprint(self.t.posts, self.links), self.clusters)

    @property
    def dims(self):
        return S.dimensions(self.t.posts, self.hits, self.t.visual, self.t.dims)

    @property
    def boosted(self):
        return S.raise_reused(self.dims, self.kb)

    @property
    def scores(self):
        return S.overall(S.components(S.wide_dimensions(self.t.posts, self.hits, self.t.visual, self.kb)))

    def _named(self, scores):
        # What the rules ask of a text is joined, not the text.
        joined = scores.join(self.meta.select("case_id", S.said(F.col("text")).alias("said")), "case_id")
        return joined.withColumn("category", S.category_said(joined, F.col("said"))).drop("said")

    @property
    def graded(self):
        """Cases with score, level and category, without the reason and what it needs."""
        return self._named(self.scores)

    @property
    def cases(self):
        return self._named(S.main_reason(self.scores, self.hits))


# ---- features --------------------------------------------------------------------------------------------------------
TAG_ANCHORS = tuple(r[1].lstrip("#").lower().translate(str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)) for r in config.LEXICON if r[0] == "hashtags")
TEXT_ANCHORS = tuple(r[1].lower().translate(str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)) for r in config.LEXICON if r[0] == "profit" and not r[3] and len(r[1]) >= 4)


class Features:
    """Raw features and numeric slots of the cases of a ``Scored``."""

    def __init__(self, s: Scored):
        self.s, self.t = s, s.t

    @property
    def parts(self):
        """Posts with what was said and what was shown."""
        shown = self.t.ocr.where("text <> ''").groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", "text"))), lambda x: x["text"]), "\n").alias("shown"))
        return self.t.posts.join(I.assemble_transcripts(self.t.segments, self.t.posts).select("case_id", "full_text"), "case_id", "left").join(shown, "case_id", "left")

    @property
    def texts(self):
        """What was said, what was shown, title, description and tags, each part on a line."""
        return self.parts.select("case_id", F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("full_text", "shown", "title", "description", "tags")]).alias("text"))

    @property
    def raw(self):
        posts = self.t.posts.select("case_id", I.coerce_hashtags(F.col("tags")).alias("hashtags"))
        return X.raw_features(posts, self.s.hits, self.s.links, self.t.visual, self.t.segments, self.t.media, self.texts, self.s.kb)

    @property
    def slots(self):
        return X.numeric_table(self.raw, TAG_ANCHORS, TEXT_ANCHORS)


COERCED = r"list_filter(regexp_split_to_array(coalesce(tags, ''), '[,\s]+'), lambda x: x <> '')"
FEATURE_TEXTS = """SELECT p.case_id, concat_ws(chr(10), CASE WHEN said <> '' THEN said END, CASE WHEN shown <> '' THEN shown END, CASE WHEN title <> '' THEN title END, CASE WHEN description <> '' THEN description END, CASE WHEN tags <> '' THEN tags END) AS text FROM posts p
 LEFT JOIN (SELECT case_id, string_agg(trim(text), ' ' ORDER BY start_s, seg_no) AS said FROM (SELECT case_id, seg_no, start_s, text FROM segments WHERE trim(text) <> '' UNION ALL SELECT case_id, -1, 0, provided_transcript FROM posts WHERE trim(provided_transcript) <> '') GROUP BY 1) s USING (case_id)
 LEFT JOIN (SELECT case_id, string_agg(text, chr(10) ORDER BY frame) AS shown FROM ocr WHERE text <> '' GROUP BY 1) o USING (case_id)"""
MOST_OF = lambda dim: f"coalesce(max(CASE WHEN source = 'Behavior' AND dim = '{dim}' THEN confidence END), 0) / 100"
LIKE_HINT = "regexp_extract_all(lower(text), '[{}]')"
RAW_SQL = f"""SELECT p.case_id, {COERCED} AS hashtags, coalesce(x.text, '') AS text, {', '.join(f'coalesce(behavior_{d}, 0) AS behavior_{d}' for d in X.BEHAVIOURS)}, coalesce(behavior_count, 0) AS behavior_count, coalesce(behavior_negative, 0) AS behavior_negative,
 {', '.join(f'coalesce(link_{k}, 0) AS link_{k}' for k in X.KINDS)}, {', '.join(f'coalesce(visual_{d}, 0) AS visual_{d}' for d in config.DIMENSIONS)}, coalesce(num_segments, 0) AS num_segments, coalesce(duration_s, 0) AS duration_s, coalesce(kb_score, 0) / 100::DOUBLE AS kb_similarity
 FROM posts p LEFT JOIN feature_texts x USING (case_id) LEFT JOIN (SELECT case_id, {', '.join(f'{MOST_OF(d)} AS behavior_{d}' for d in X.BEHAVIOURS)}, count(*) FILTER (source = 'Behavior') AS behavior_count, coalesce(max(CASE WHEN dim = 'negative' THEN confidence END), 0) / 100 AS behavior_negative FROM hits GROUP BY 1) b USING (case_id)
 LEFT JOIN (SELECT case_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS link_{k}" for k in X.KINDS)} FROM links GROUP BY 1) l USING (case_id) LEFT JOIN (SELECT case_id, {', '.join(f"max(score) FILTER (dim = '{d}') AS visual_{d}" for d in config.DIMENSIONS)} FROM visual GROUP BY 1) v USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) AS num_segments FROM segments WHERE trim(text) <> '' GROUP BY 1) s USING (case_id) LEFT JOIN (SELECT case_id, duration_s FROM media) m USING (case_id) LEFT JOIN kb USING (case_id)"""
HINTED = f"SELECT *, CASE WHEN c + l = 0 THEN '' WHEN k > 0 AND c / (c + l)::DOUBLE > 0.3 THEN 'kz' WHEN c / (c + l)::DOUBLE > 0.25 AND c / (c + l)::DOUBLE < 0.75 THEN 'mixed' WHEN c / (c + l)::DOUBLE >= 0.75 THEN 'ru' ELSE 'en' END AS lang_hint FROM (SELECT *, len({LIKE_HINT.format('а-яё' + T.KAZAKH)}) AS c, len({LIKE_HINT.format('a-z')}) AS l, len({LIKE_HINT.format(T.KAZAKH)}) AS k FROM raw0)"
CAPPED = lambda x, most: f"least(({x})::DOUBLE, {most}) / {most}"
FOLDED = f"translate(lower({{}}), '{T.CONFUSABLE_FROM}', '{T.CONFUSABLE_TO}')"
BAD_TAG = " OR ".join(f"contains(x, '{a}') OR contains('{a}', x)" for a in TAG_ANCHORS)
SLOT_SQL = (
    *(f"visual_{d}::DOUBLE" for d in config.DIMENSIONS), *(f"behavior_{d}" for d in X.BEHAVIOURS), CAPPED("behavior_count", 5), "behavior_negative", *(CAPPED(f"link_{k}", 4) for k in ("telegram", "whatsapp", "url", "promocode", "phone")),
    CAPPED(" + ".join(f"link_{k}" for k in X.KINDS), 8), "least(1, greatest(0, kb_similarity))", "least(ln(1 + greatest(0, duration_s)) / ln(601::DOUBLE), 1)", CAPPED("num_segments", 40), CAPPED("len(hashtags)", 12),
    f"CASE WHEN len(hashtags) > 0 THEN len(list_filter(list_transform(hashtags, lambda x: replace({FOLDED.format('x')}, '#', '')), lambda x: x <> '' AND ({BAD_TAG}))) / len(hashtags)::DOUBLE ELSE 0 END",
    "least(ln(1 + length(text)) / ln(2001::DOUBLE), 1)", "(link_url > 0)::INT", "(link_telegram > 0 OR link_whatsapp > 0)::INT", "(link_promocode > 0)::INT", "CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[0-9]')) / length(text)::DOUBLE ELSE 0 END",
    "least(len(regexp_extract_all(text, '[\U0001f300-\U0001faff☀-➿\u200b\u200c\u200d]')), 20) / 20.0::DOUBLE", "least(" + " + ".join(f"(length({FOLDED.format('text')}) - length(replace({FOLDED.format('text')}, '{a}', ''))) // {len(a)}" for a in TEXT_ANCHORS) + ", 5) / 5.0::DOUBLE",
    "CASE lang_hint WHEN 'kz' THEN 0.33 WHEN 'en' THEN 0.66 WHEN 'mixed' THEN 1.0 ELSE 0.0 END",
)
FEATURED = with_(**CHAIN, media=SQL["media"], feature_texts=FEATURE_TEXTS, raw0=RAW_SQL, raw=HINTED)


@query("tx1_case_texts", FEATURED + """SELECT p.case_id, sha256(concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(tags) <> '' THEN tags END, CASE WHEN trim(said) <> '' THEN said END, CASE WHEN trim(shown) <> '' THEN shown END)) AS v FROM posts p
 LEFT JOIN (SELECT case_id, string_agg(trim(text), ' ' ORDER BY start_s, seg_no) AS said FROM (SELECT case_id, seg_no, start_s, text FROM segments WHERE trim(text) <> '' UNION ALL SELECT case_id, -1, 0, provided_transcript FROM posts WHERE trim(provided_transcript) <> '') GROUP BY 1) s USING (case_id)
 LEFT JOIN (SELECT case_id, string_agg(text, chr(10) ORDER BY frame) AS shown FROM ocr WHERE text <> '' GROUP BY 1) o USING (case_id)""")
def _(t):
    """Everything that a case says: title, description, tags, what is spoken, what is shown."""
    parts = Features(Scored(t)).parts
    return parts.select("case_id", F.sha2(T.all_text(*[F.col(c) for c in ("title", "description", "tags", "full_text", "shown")]), 256).alias("v"))


@query("ag16_raw_features", FEATURED + f"SELECT case_id, sha256(text) AS text, len(hashtags) AS hashtags, lang_hint, num_segments, behavior_count, round(behavior_urgency, 6) AS urgency, round(behavior_negative, 6) AS negative, {', '.join(f'link_{k}' for k in X.KINDS)}, round(visual_gambling, 6) AS gambling, duration_s::DOUBLE AS duration_s, round(kb_similarity, 6) AS kb FROM raw")
def _(t):
    raw = Features(Scored(t)).raw
    return raw.select("case_id", F.sha2("text", 256).alias("text"), F.size("hashtags").alias("hashtags"), "lang_hint", "num_segments", "behavior_count", F.round("behavior_urgency", 6).alias("urgency"), F.round("behavior_negative", 6).alias("negative"), *[f"link_{k}" for k in X.KINDS], F.round("visual_gambling", 6).alias("gambling"), F.col("duration_s").cast("double").alias("duration_s"), F.round("kb_similarity", 6).alias("kb"))


@query("ag17_numeric_slots", FEATURED + "SELECT case_id, " + ", ".join(f"round(({x})::DOUBLE, 6) AS v{k}" for k, x in enumerate(SLOT_SQL)) + " FROM raw")
def _(t):
    slots = Features(Scored(t)).slots
    return slots.select("case_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in slots.columns if c != "case_id"])


LEXICAL = with_(**{n: CHAIN[n] for n in ("posts", "lexicon", "meta")}) + f"SELECT {{}} FROM ({matches('meta', 'lexicon')}) GROUP BY ALL"


@query("mx1_count_phrases", LEXICAL.format("case_id, ord, count(*) AS n"))
def _(t):
    return M.count_phrases(M.find_matches(M.meta_text(t.posts), t.lexicon))


@query("mx1_find_matches", LEXICAL.format("case_id, ord, pos, any_value(matched) AS matched"))
def _(t):
    return M.find_matches(M.meta_text(t.posts), t.lexicon).select("case_id", "ord", "pos", "matched")


@query("mx2_chips", LEXICAL.format("case_id, ord, chip"))
def _(t):
    return M.find_matches(M.meta_text(t.posts), t.lexicon, every=False).select("case_id", "ord", "chip").distinct()


HIT_COLUMNS = "case_id, source, rule_ord, confidence, dim, chip, fragment"


def hits_query(name, table, build):
    @query(name, chain(f"SELECT {HIT_COLUMNS}, seg_no, time_s FROM {table}"))
    def _(t):
        return build(Scored(t)).select(*HIT_COLUMNS.split(", "), "seg_no", "time_s")


for _name, _source in (("mx3_meta_hits", "Metadata"), ("mx4_speech_hits", "Audio"), ("mx5_screen_hits", "OCR")):
    hits_query(_name, f"phrase_hits WHERE source = '{_source}'", lambda s, source=_source: M.scan(s.found).where(F.col("source") == source))
hits_query("mx6_negative_hits", "neg_hits", lambda s: M.scan_negatives(s.found))
for _n, _kind in enumerate(("telegram", "whatsapp", "phone", "promocode", "url"), 7):

    def _links_of(kind, name):
        @query(name, chain(f"SELECT case_id, value, source_field FROM links WHERE kind = '{kind}'"))
        def _(t):
            return Scored(t).links.where(F.col("kind") == kind).select("case_id", "value", "source_field")

    _links_of(_kind, f"mx{_n}_{_kind}")


@query("mx12_link_hits", chain("SELECT case_id, confidence, signal, dim FROM link_hits"))
def _(t):
    return M.link_hits(Scored(t).links).select("case_id", "confidence", "signal", "dim")


@query("mx12_links_in_pages", f"WITH texts AS (SELECT page_id AS case_id, 'html' AS source_field, 0 AS place, html AS text FROM pages), links AS ({LINKS}) SELECT case_id, kind, value FROM links")
def _(t):
    return M.extract_links(t.pages.select(F.col("page_id").alias("case_id"), F.lit("html").alias("source_field"), F.lit(0).alias("place"), F.col("html").alias("text"))).select("case_id", "kind", "value")


hits_query("mx13_funnel_hits", "funnel_hits", lambda s: M.funnel_hits(s.links, s.t.funnel))
hits_query("mx14_call_hits", "call_hits", lambda s: s.calls)


@query("mx15_locate_times", chain("SELECT h.case_id, chip, min(t.time_s) AS time_s FROM hits h JOIN (SELECT case_id, time_s, text FROM speech UNION ALL SELECT case_id, time_s, text FROM screen) t ON t.case_id = h.case_id AND contains(lower(t.text), lower(chip)) GROUP BY 1, 2"))
def _(t):
    s = Scored(t)
    return M.locate_times(s.hits, s.speech.unionByName(s.screen))


@query("mx16_all_hits", chain("SELECT case_id, lane, source, rule_ord, confidence, dim, chip FROM hits"))
def _(t):
    return Scored(t).hits.select("case_id", "lane", "source", "rule_ord", "confidence", "dim", "chip")


@query("mx17_changed_cases", chain("SELECT case_id, count(*) AS n, round(sum(confidence), 6) AS total FROM hits WHERE case_id IN (SELECT case_id FROM segments UNION SELECT case_id FROM ocr) GROUP BY 1"))
def _(t):
    # Only the texts of changed cases are looked at again.
    changed = materialise(t.segments.select("case_id").union(t.ocr.select("case_id")).distinct())
    return Scored(t, only=changed).hits.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


class Touched:
    """Inputs of some cases, with the texts that have arrived for them."""

    def __init__(self, t: Inputs, texts, touched):
        self.t, self.texts, self.touched = t, texts, touched

    def __getattr__(self, name: str):
        if name == "segments":
            return self.texts.where("kind = 'speech'").select("case_id", F.col("no").alias("seg_no"), F.col("time_s").alias("start_s"), "text")
        if name == "ocr":
            return self.texts.where("kind = 'frame'").select("case_id", F.col("no").alias("frame"), "time_s", "text")
        found = getattr(self.t, name)
        return found.join(self.touched, "case_id", "left_semi") if name in ("posts", "visual") else found


SCORED_CASE = ("case_id", "score", "level", "category")


@query("mx17_second_pass", chain("SELECT case_id, score, level, category FROM category"))
def _(t):
    """All cases are scored from their posts; then speech and frames arrive as a stream of files, and only the cases that they touch are scored again."""
    folder = f"{shared_folder(t.spark)}/cases-{uuid.uuid4().hex}"
    store = CaseStore(t.spark, folder, lambda texts, touched: Scored(Touched(t, texts, touched)).graded.select(*SCORED_CASE), buckets=8)
    store.fill(t.posts)
    speech = t.segments.select("case_id", F.lit("speech").alias("kind"), F.col("seg_no").cast("long").alias("no"), F.col("start_s").alias("time_s"), "text")
    frames = t.ocr.select("case_id", F.lit("frame").alias("kind"), F.col("frame").cast("long").alias("no"), "time_s", "text")
    speech.unionByName(frames).withColumn("sent", F.lit(0).cast("long")).write.parquet(f"{folder}/arrived")
    store.follow(t.spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 64).parquet(f"{folder}/arrived")).awaitTermination()
    return store.cases


@query("mx18_escalate", chain("SELECT case_id, (filename IS NOT NULL) AND (score >= 8 OR length(trim(coalesce(text, ''))) < 40) AS escalate FROM overall JOIN (SELECT case_id, filename, text FROM posts JOIN meta USING (case_id)) USING (case_id)"))
def _(t):
    s = Scored(t)
    joined = s.scores.join(t.posts.select("case_id", "filename").join(s.meta.select("case_id", "text"), "case_id"), "case_id")
    return joined.select("case_id", M.escalate(F.col("score"), F.coalesce("text", F.lit("")), F.col("filename").isNotNull()).alias("escalate"))


PROMPT_SQL = f"""WITH prompts AS (SELECT label, list(m ORDER BY k) AS vector, any_value(dim) AS dim, any_value(name) AS name FROM (SELECT e.label, k, avg(x) AS m, v.dim, v.label AS name FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) e JOIN {values([(k, *p) for k, p in enumerate(config.PROMPTS)], 'no, label, dim')} ON e.label = v.no GROUP BY 1, 2, 4, 5) GROUP BY 1),
z AS (SELECT CAST(floor(vec_id / 4) AS BIGINT) AS case_id, vec_id AS frame, p.name AS label, p.dim, 100 * list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), p.vector) AS z FROM embeddings, prompts p),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY frame)) AS e FROM z), q AS (SELECT *, e / sum(e) OVER (PARTITION BY frame) AS p FROM p)
SELECT case_id, frame, label, dim, round(p, 6) AS p FROM q WHERE dim <> '' AND p > 0.18 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY p DESC, frame, label) <= 6"""


@query("mx19_image_labels", PROMPT_SQL)
def _(t):
    names = t.spark.createDataFrame([(k, *p) for k, p in enumerate(config.PROMPTS)], "no int, label string, dim string")
    # A prompt's vector is the mean of its label's: one buffer per label and task.
    means = t.embeddings.groupBy(F.col("label").alias("no")).agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    prompts = means.join(names, "no").select("label", "dim", vector_to_array("m").alias("vector"))
    frames = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("case_id"), F.col("vec_id").alias("frame"), "embedding")
    return M.image_labels(frames, prompts).withColumn("p", F.round("p", 6))


@query("ag1_fold", chain(f"SELECT case_id, source, round({FOLD.format('confidence')}, 6) AS v FROM hits GROUP BY 1, 2"))
def _(t):
    return Scored(t).hits.groupBy("case_id", "source").agg(F.round(S.fold(F.col("confidence")), 6).alias("v"))


@query("ag2_dimensions", chain("SELECT case_id, dim, value FROM dim_rows"))
def _(t):
    return Scored(t).dims.select("case_id", "dim", "value")


@query("ag3_strongest", chain("SELECT case_id, dim, best FROM best"))
def _(t):
    return S.strongest(Scored(t).hits, "dim", F.coalesce(F.nullif(F.trim("fragment"), F.lit("")), F.col("signal")))


@query("ag4_wide_dimensions", chain("SELECT * FROM wide"))
def _(t):
    w = S.wide(Scored(t).boosted)
    return w.select("case_id", *[F.col(d).cast("double").alias(d) for d in config.DIMENSIONS])


@query("ag5_components", chain("SELECT case_id, round(text_speech, 6) AS text_speech, round(visual_part, 6) AS visual_part, round(metadata_links, 6) AS metadata_links, round(behavior, 6) AS behavior, db_similarity FROM parts"))
def _(t):
    c = S.components(S.wide(Scored(t).boosted))
    return c.select("case_id", *[F.round(x, 6).alias(x) for x in ("text_speech", "visual_part", "metadata_links", "behavior")], "db_similarity")


@query("ag6_overall", chain("SELECT case_id, round(overall, 6) AS overall FROM overall"))
def _(t):
    return Scored(t).scores.select("case_id", F.round("overall", 6).alias("overall"))


@query("ag7_negatives", chain("SELECT case_id, round(neg, 6) AS neg FROM neg"))
def _(t):
    return S.negatives(Scored(t).hits).withColumn("neg", F.round("neg", 6))


@query("ag8_main_reason", chain("SELECT case_id, top_dim, reason FROM reason"))
def _(t):
    s = Scored(t)
    return S.main_reason(s.scores, s.hits).select("case_id", "top_dim", "reason")


@query("ag9_score_level", chain("SELECT case_id, score, level FROM overall"))
def _(t):
    return Scored(t).scores.select("case_id", "score", "level")


@query("ag10_fingerprint", chain("SELECT case_id, array_to_string(list_sort(handles), '|') AS handles, array_to_string(list_sort(tags), '|') AS tags, length(text) AS n FROM prints"))
def _(t):
    p = S.fingerprint(t.posts, Scored(t).links)
    return p.select("case_id", F.array_join(F.array_sort("handles"), "|").alias("handles"), F.array_join(F.array_sort("tags"), "|").alias("tags"), F.length("text").alias("n"))


@query("ag12_kb_cluster", chain("SELECT case_id, cluster, round(raw, 6) AS raw, kb_score FROM kb"))
def _(t):
    return Scored(t).kb.withColumn("raw", F.round("raw", 6))


@query("ag11_kb_similarity", chain("SELECT case_id, cluster, round(raw, 6) AS raw FROM kb_all"))
def _(t):
    s = Scored(t)
    return S.kb_all_pairs(S.fingerprint(t.posts, s.links), s.clusters).select("case_id", "cluster", F.round("raw", 6).alias("raw"))


@query("ag13_raise_reused", chain("SELECT case_id, dim, value FROM boosted WHERE dim = 'reused'"))
def _(t):
    return Scored(t).boosted.where("dim = 'reused'").select("case_id", "dim", "value")


@query("ag14_category", chain("SELECT case_id, category FROM category"))
def _(t):
    return Scored(t).graded.select("case_id", "category")


# The strongest component of text stands for a model's score; cases without any hit have none.
SECOND = "CAST(least(100, greatest(0, round_even(text_speech, 0))) AS INTEGER)"
MIXED = "CAST(least(100, greatest(0, round_even(0.6::DOUBLE * model + (1 - 0.6::DOUBLE) * score, 0))) AS INTEGER)"


@query("ag15_modes", chain(f"SELECT case_id, CASE WHEN model IS NULL THEN score ELSE {MIXED} END AS blend, coalesce(model, score) AS model, score AS rules FROM (SELECT o.case_id, score, CASE WHEN h.case_id IS NOT NULL THEN {SECOND} END AS model FROM overall o LEFT JOIN (SELECT DISTINCT case_id FROM hits) h USING (case_id))"))
def _(t):
    s = Scored(t)
    joined = s.scores.join(s.hits.select("case_id").distinct().withColumn("some", F.lit(True)), "case_id", "left")
    model = F.when(F.col("some"), T.clamp(F.col("text_speech")))
    return joined.select("case_id", *[S.blend(F.col("score"), model, mode).alias(mode) for mode in ("blend", "model", "rules")])


@query("ag15_blend", chain("SELECT case_id, CASE WHEN case_id % 3 = 0 THEN score ELSE CAST(least(100, greatest(0, round_even(0.6::DOUBLE * (case_id % 101) + (1 - 0.6::DOUBLE) * score, 0))) AS INTEGER) END AS blended FROM overall"))
def _(t):
    model = F.when(F.col("case_id") % 3 != 0, F.col("case_id") % 101)
    return Scored(t).scores.select("case_id", S.blend(F.col("score"), model).alias("blended"))


@query("ag19_score_posts", chain("SELECT case_id, score, level, category, top_dim, reason, " + ", ".join(config.DIMENSIONS) + " FROM category"))
def _(t):
    return Scored(t).cases.select("case_id", "score", "level", "category", "top_dim", "reason", *[F.col(d).cast("double").alias(d) for d in config.DIMENSIONS])
