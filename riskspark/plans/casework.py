"""Queries of timelines, evidence and connection graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark import config
from riskspark.operators import documents as D
from riskspark.operators import graph as G
from riskspark.operators import score as S
from riskspark.operators import timeline as L
from riskspark.plans.base import query
from riskspark.plans.intake import COERCED, FLAT, TAGGED
from riskspark.plans.scoring import CHAIN, Scored, chain
from riskspark.sources import intake as I
from riskspark.sources.fixtures import values, with_

# Quotes of any column.
Q = lambda c: "(" + ("CASE WHEN {f} = '' THEN '' WHEN length({f}) > 160 THEN '«' || rtrim(substr({f}, 1, 157)) || '…»' ELSE '«' || {f} || '»' END").replace("{f}", FLAT.replace("description", c)) + ")"
RANK = "CASE WHEN confidence >= 85 THEN 3 WHEN confidence >= 65 THEN 2 WHEN confidence >= 45 THEN 1 ELSE 0 END"
CAND = "SELECT case_id, time_s, source, signal, confidence FROM hits WHERE time_s IS NOT NULL AND trim(signal) <> '' UNION ALL SELECT case_id, time_s, 'Visual', label, score * 100 FROM visual WHERE trim(label) <> ''"


@query("wn1_candidates", chain(f"SELECT case_id, time_s, source, signal, round(confidence, 6) AS confidence FROM ({CAND})"))
def _(t):
    return L.candidates(Scored(t).hits, t.visual).withColumn("confidence", F.round("confidence", 6))


@query("wn2_dedup")
def _(t):
    return L.dedup(L.candidates(Scored(t).hits, t.visual)).withColumn("confidence", F.round("confidence", 6))


# Events far apart, so that only equal signals meet: each source and signal once, the strongest of them.
FAR = "SELECT user_id AS case_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS DOUBLE) AS time_s, event_type AS source, event_type AS signal, least(100, value) AS confidence FROM events"


@query("wn2_dedup_events", f"WITH e AS ({FAR}) SELECT case_id, source, round(max(confidence), 6) AS confidence FROM e GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = t.events.select(F.col("user_id").alias("case_id"), (n * 10).cast("double").alias("time_s"), F.col("event_type").alias("source"), F.col("event_type").alias("signal"), F.least(F.lit(100.0), "value").alias("confidence"))
    return L.dedup(events).select("case_id", "source", F.round("confidence", 6).alias("confidence"))


# The greedy step of wn2 is not for SQL; a test folds the same events one by one.
@query("wn3_timeline")
def _(t):
    return L.build_timeline(L.dedup(L.candidates(Scored(t).hits, t.visual)))


def card_sql(source: str, kind: str, extras: str = "") -> str:
    own = f"SELECT * FROM hits WHERE source = '{source}' AND dim <> 'negative'"
    rows = f"SELECT case_id, 1 AS g, lane, seg_no, rule_ord, pos, trim(chip) AS chip FROM ({own}) WHERE trim(chip) <> ''"
    if extras:
        rows += f" UNION ALL SELECT case_id, 0, 0, 0, 0, n, trim(chip) FROM ({extras}) WHERE trim(chip) <> '' AND case_id IN (SELECT case_id FROM ({own}))"
    found = f"SELECT case_id, string_agg(chip, '|' ORDER BY k) AS findings FROM (SELECT case_id, chip, row_number() OVER (PARTITION BY case_id ORDER BY g, lane, seg_no, rule_ord, pos, chip) AS k FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY case_id, lower(chip) ORDER BY g, lane, seg_no, rule_ord, pos, chip) = 1)) WHERE k <= 6 GROUP BY 1"
    best = f"SELECT case_id, confidence, coalesce(nullif(trim(fragment), ''), signal) AS best FROM ({own}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, lane, seg_no, rule_ord, pos, signal DESC) = 1"
    return f"SELECT b.case_id, '{kind}' AS type, CAST(round_even(confidence, 0) AS INTEGER) AS confidence, {Q('best')} AS fragment, coalesce(findings, '') AS findings FROM ({best}) b LEFT JOIN ({found}) f USING (case_id)"


def fallback(cards: str, other: str) -> str:
    return f"SELECT * FROM ({cards}) UNION ALL SELECT * FROM ({other}) WHERE case_id NOT IN (SELECT case_id FROM ({cards}))"


SPOKEN = f"SELECT case_id, 'audio' AS type, 40 AS confidence, {Q('full_text')} AS fragment, '' AS findings FROM (SELECT case_id, string_agg(trim(text), ' ' ORDER BY start_s, seg_no) AS full_text FROM (SELECT case_id, seg_no, start_s, text FROM segments WHERE trim(text) <> '' UNION ALL SELECT case_id, -1, 0, provided_transcript FROM posts WHERE trim(provided_transcript) <> '') GROUP BY 1)"
SHOWN = f"SELECT case_id, 'ocr' AS type, CAST(least(100, greatest(0, round_even(confidence, 0))) AS INTEGER) AS confidence, {Q('text')} AS fragment, '' AS findings FROM ocr QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, frame) = 1"
EXTRA = f"SELECT case_id, unnest(l) AS chip, generate_subscripts(l, 1) - 1 AS n FROM (SELECT case_id, {COERCED} AS l FROM posts)"


@query("wn4_card_audio", chain(fallback(card_sql("Audio", "audio"), SPOKEN)))
def _(t):
    return L.speech_card(Scored(t).hits, I.assemble_transcripts(t.segments, t.posts))


@query("wn5_card_ocr", chain(fallback(card_sql("OCR", "ocr"), SHOWN)))
def _(t):
    return L.screen_card(Scored(t).hits, t.ocr)


@query("wn6_card_visual", with_("visual") + f"SELECT case_id, 'visual' AS type, CAST(round_even(max(score) * 100, 0) AS INTEGER) AS confidence, {Q('max(CASE WHEN k = 1 THEN label END)')} AS fragment, string_agg(label, '|' ORDER BY k) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, label) AS k FROM (SELECT case_id, label, max(score) AS score FROM visual GROUP BY 1, 2)) WHERE k <= 6 GROUP BY 1")
def _(t):
    return L.image_card(t.visual)


@query("wn7_card_metadata", chain(card_sql("Metadata", "metadata", EXTRA)))
def _(t):
    return L.hit_card(Scored(t).hits, "Metadata", "metadata", t.posts.select("case_id", I.coerce_hashtags(F.col("tags")).alias("tags")))


@query("wn8_card_links", chain(f"""SELECT case_id, 'links' AS type, CAST(round_even(coalesce(c, 70), 0) AS INTEGER) AS confidence, {Q("array_to_string(v, '; ')")} AS fragment, array_to_string(v[1:6], '|') AS findings FROM (SELECT case_id, list(value ORDER BY place, kind_ord, at0) AS v FROM (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY case_id, value ORDER BY place, kind_ord, at0) = 1) GROUP BY 1) LEFT JOIN (SELECT case_id, max(confidence) AS c FROM hits WHERE dim IN ('messenger', 'referral') GROUP BY 1) USING (case_id)"""))
def _(t):
    s = Scored(t)
    return L.link_card(s.links, s.hits)


@query("wn9_card_engagement", chain(card_sql("Behavior", "engagement")))
def _(t):
    return L.hit_card(Scored(t).hits, "Behavior", "engagement")


@query("wn10_findings", chain("SELECT case_id, string_agg(chip, '|' ORDER BY k) AS findings FROM (SELECT case_id, chip, row_number() OVER (PARTITION BY case_id ORDER BY lane, seg_no, rule_ord, pos, chip) AS k FROM (SELECT * REPLACE (trim(chip) AS chip) FROM hits WHERE trim(chip) <> '' QUALIFY row_number() OVER (PARTITION BY case_id, lower(trim(chip)) ORDER BY lane, seg_no, rule_ord, pos, trim(chip)) = 1)) WHERE k <= 6 GROUP BY 1"))
def _(t):
    return L.findings(Scored(t).hits)


@query("wn11_strongest_time", chain("SELECT case_id, time_s, confidence FROM hits WHERE time_s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, time_s, source, signal) = 1"))
def _(t):
    timed = Scored(t).hits.where("time_s is not null")
    best = timed.groupBy("case_id").agg(F.max(F.struct("confidence", (-F.col("time_s")).alias("n"))).alias("b"))
    return best.select("case_id", (-F.col("b.n")).alias("time_s"), F.col("b.confidence").alias("confidence"))


TIER = "CASE WHEN value >= 80 THEN 'strong' WHEN value >= 50 THEN 'clear' ELSE 'weak' END"


@query("wn14_top_dimensions", chain(f"SELECT case_id, dim, value, {TIER} AS tier FROM boosted WHERE value >= 40 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY value DESC, dim_no) <= 2"))
def _(t):
    from riskspark.operators.score import best_k

    top = best_k(Scored(t).boosted.where("value >= 40"), 2, [F.desc("value"), "dim_no"])
    return top.select("case_id", "dim", "value", F.when(F.col("value") >= 80, "strong").when(F.col("value") >= 50, "clear").otherwise("weak").alias("tier"))


TOP2 = "SELECT case_id, string_agg(dim, ', ' ORDER BY value DESC, dim_no) AS dims FROM (SELECT * FROM boosted WHERE value >= 40 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY value DESC, dim_no) <= 2) GROUP BY 1"


@query("tx25_description", chain(f"SELECT case_id, concat_ws('; ', level || ' risk ' || score, reason, 'mainly ' || dims, CASE WHEN kb_score >= 30 THEN 'like ' || cluster END) AS line FROM reason LEFT JOIN ({TOP2}) USING (case_id) LEFT JOIN kb USING (case_id)"))
def _(t):
    from riskspark.operators.score import best_k

    s = Scored(t)
    top = best_k(s.boosted.where("value >= 40"), 2, [F.desc("value"), "dim_no"]).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "dim_no", "dim"))), lambda x: x["dim"]), ", ").alias("dims"))
    joined = s.cases.join(top, "case_id", "left").join(s.kb, "case_id", "left")
    return joined.select("case_id", F.concat_ws("; ", F.concat_ws(" ", "level", F.lit("risk"), "score"), "reason", F.concat(F.lit("mainly "), "dims"), F.when(F.col("kb_score") >= 30, F.concat(F.lit("like "), "cluster"))).alias("line"))


# ---- graph -----------------------------------------------------------------------------------------------------------
RELATED = [(c, k, label, kind) for c, _, _, _, _, _, rel in config.CLUSTERS for k, (label, kind, _) in enumerate(rel, 1)]
HANDLES = "SELECT case_id, n, '@' || value AS label FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place, kind_ord, at0, value) AS n FROM links WHERE kind = 'telegram') WHERE n <= 4"
TAGS = "SELECT case_id, n, label FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, pos) AS n, label FROM (SELECT case_id, lower(tag) AS low, count(*) AS c, min(pos) AS pos, arg_min(tag, pos) AS label FROM (SELECT case_id, unnest(l) AS tag, generate_subscripts(l, 1) AS pos FROM tagged) GROUP BY 1, 2)) WHERE n <= 5"
NEAR = "SELECT case_id, n, label, type FROM kb JOIN " + values(RELATED, "cluster, n, label, type") + " USING (cluster) WHERE n <= 5"
NODES = "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY g, n, type) AS k, type, label FROM (SELECT * FROM (SELECT case_id, 0 AS g, n, 'telegram' AS type, label FROM handles UNION ALL SELECT case_id, 1, n, 'hashtag', label FROM top_tags UNION ALL SELECT case_id, 2, n, type, label FROM near) QUALIFY row_number() OVER (PARTITION BY case_id, type, lower(label) ORDER BY g, n, label) = 1)"
GRAPH = with_(**CHAIN, tagged=TAGGED, handles=HANDLES, top_tags=TAGS, near=NEAR, nodes=NODES)


class Graph:
    def __init__(self, t, s=None):
        s = s or Scored(t)
        self.t, self.s = t, s
        self.links, self.kb = s.links, s.kb
        self.tags = t.posts.select("case_id", I.resolve_hashtags(F.col("tags"), F.col("title"), F.col("description"), F.col("tags"), F.col("provided_transcript")).alias("tags"))
        self.rows = t.spark.createDataFrame(RELATED, "cluster string, n int, label string, type string")

    @property
    def nodes(self):
        return G.neighbours(G.top_handles(self.links), G.top_tags(self.tags), G.related(self.kb, self.rows))


@query("gr1_handles", GRAPH + "SELECT case_id, n, label FROM handles")
def _(t):
    return G.top_handles(Graph(t).links)


@query("gr2_hashtags", GRAPH + "SELECT case_id, n, label FROM top_tags")
def _(t):
    return G.top_tags(Graph(t).tags)


@query("gr3_related", GRAPH + "SELECT * FROM near")
def _(t):
    g = Graph(t)
    return G.related(g.kb, g.rows)


LABEL = "SELECT case_id, coalesce(nullif(substr(trim(title), 1, 40), ''), nullif(substr(filename, 1, 40), ''), 'case') AS label FROM posts"


def _labels(t):
    return t.posts.select("case_id", F.coalesce(F.nullif(F.substring(F.trim("title"), 1, 40), F.lit("")), F.nullif(F.substring("filename", 1, 40), F.lit("")), F.lit("case")).alias("label"))


@query("gr4_nodes", GRAPH + f"SELECT case_id, 'n' || k AS id, type, label FROM nodes UNION ALL SELECT case_id, 'v1', 'video', label FROM ({LABEL})")
def _(t):
    return G.with_center(Graph(t).nodes, _labels(t))


@query("gr4_edges", GRAPH + "SELECT case_id, 'e' || k AS id, 'v1' AS source, 'n' || k AS target, CASE type WHEN 'telegram' THEN 'contact' WHEN 'hashtag' THEN 'hashtag' ELSE 'similar' END AS type FROM nodes")
def _(t):
    return G.edges(Graph(t).nodes)


@query("gr5_ring", GRAPH + "SELECT case_id, 'n' || k AS id, round(50 + (35 + 4 * ((k - 1) % 3)) * cos(2 * pi() * (k - 1) / count(*) OVER (PARTITION BY case_id)), 4) AS x, round(50 + (35 + 4 * ((k - 1) % 3)) * sin(2 * pi() * (k - 1) / count(*) OVER (PARTITION BY case_id)), 4) AS y FROM nodes")
def _(t):
    return G.ring(Graph(t).nodes)


@query("gr6_cluster_size", GRAPH + "SELECT case_id, greatest(coalesce(size, 0), count(*)) AS size FROM nodes JOIN kb USING (case_id) LEFT JOIN clusters USING (cluster) GROUP BY case_id, size")
def _(t):
    return _cluster(Graph(t)).select("case_id", "size")


ABOUT = "SELECT * FROM " + values([(c, d) for c, d, *_ in config.CLUSTERS], "cluster, about")


def _cluster(g):
    """Size and description of the cluster of every case with neighbours."""
    known = g.t.spark.createDataFrame([(c, d, n) for c, d, n, *_ in config.CLUSTERS], "cluster string, about string, size int")
    n = g.nodes.groupBy("case_id").agg(F.count("*").alias("n"))
    size = F.greatest(F.coalesce("size", F.lit(0)), "n").cast("long")
    own = F.concat(F.lit("linked items: "), F.col("n").cast("string"))
    return n.join(g.kb, "case_id").join(known, "cluster", "left").select("case_id", size.alias("size"), F.coalesce("about", own).alias("description"))


@query("gr6_cluster", GRAPH.rstrip() + f",\nabout AS ({ABOUT}) SELECT case_id, greatest(coalesce(size, 0), count(*)) AS size, coalesce(about, 'linked items: ' || count(*)) AS description FROM nodes JOIN kb USING (case_id) LEFT JOIN clusters USING (cluster) LEFT JOIN about USING (cluster) GROUP BY case_id, size, about")
def _(t):
    return _cluster(Graph(t))


@query("gr7_central_label", with_("posts") + LABEL)
def _(t):
    return _labels(t)


@query("gr8_node_counts", GRAPH + "SELECT case_id, type, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT case_id, 'edges', count(DISTINCT 'n' || k) FROM nodes GROUP BY 1")
def _(t):
    nodes = Graph(t).nodes
    links = G.edges(nodes).groupBy("case_id").agg(F.lit("edges").alias("type"), F.count_distinct("source", "target").alias("n"))
    return nodes.groupBy("case_id", "type").agg(F.count("*").alias("n")).unionByName(links)


# A post's account is who published it: here the source of its document.
ENTITIES = "SELECT DISTINCT case_id, lower(label) AS entity FROM (SELECT case_id, label FROM handles UNION ALL SELECT case_id, label FROM top_tags UNION ALL SELECT doc_id, 'account:' || source FROM documents WHERE source IS NOT NULL)"


def _entities(t):
    g = Graph(t)
    accounts = t.documents.where("source is not null").select(F.col("doc_id").alias("case_id"), F.concat(F.lit("account:"), "source").alias("label"))
    return G.top_handles(g.links).select("case_id", "label").unionByName(G.top_tags(g.tags).select("case_id", "label")).unionByName(accounts).select("case_id", F.lower("label").alias("entity")).distinct()


@query("gr9_shared_edges", GRAPH + f"SELECT DISTINCT a, case_id AS b FROM (SELECT case_id, min(case_id) OVER (PARTITION BY entity) AS a FROM ({ENTITIES})) WHERE case_id > a")
def _(t):
    return G.shared_edges(_entities(t))


@query("gr9_components")
def _(t):
    return G.components(G.shared_edges(_entities(t)))


def _documents(t):
    s = Scored(t)
    g = Graph(t, s)
    cards = [L.speech_card(s.hits, I.assemble_transcripts(t.segments, t.posts)), L.screen_card(s.hits, t.ocr), L.image_card(t.visual), L.hit_card(s.hits, "Metadata", "metadata", t.posts.select("case_id", I.coerce_hashtags(F.col("tags")).alias("tags"))), L.link_card(s.links, s.hits), L.hit_card(s.hits, "Behavior", "engagement")]
    return D.case_documents(t.posts, s.cases, s.boosted, L.build_timeline(L.dedup(L.candidates(s.hits, t.visual))), cards, G.with_center(g.nodes, _labels(t)), G.edges(g.nodes))


@query("ag18_case_documents")
def _(t):
    return _documents(t)


@query("ag18_document_parts", GRAPH.rstrip() + f""",\nlabels_of AS ({LABEL}) SELECT c.case_id, coalesce(p.title, '') AS title, strftime(p.created, '%Y-%m-%d') AS upload_date, score, level, category, (SELECT string_agg(dim || ':' || value, ' ' ORDER BY dim_no) FROM boosted b WHERE b.case_id = c.case_id) AS dna,
 'v1' || coalesce((SELECT string_agg(' n' || k, '' ORDER BY k) FROM nodes n WHERE n.case_id = c.case_id), '') AS nodes, coalesce((SELECT string_agg('n' || k, ' ' ORDER BY k) FROM nodes n WHERE n.case_id = c.case_id), '') AS targets FROM category c JOIN posts p USING (case_id)""")
def _(t):
    """The parts of the documents that SQL can tell: head, dimensions, nodes and edges in their order."""
    names = lambda c, f: F.array_join(F.transform(c, f), " ")
    return _documents(t).select("case_id", "title", "upload_date", "score", "level", "category", names("dna", lambda d: F.concat_ws(":", d["dim"], d["value"].cast("string"))).alias("dna"), names("nodes", lambda n: n["id"]).alias("nodes"), names("edges", lambda e: e["target"]).alias("targets"))


@query("wn11_strongest", chain("SELECT case_id, source, time_s, fragment, explanation, confidence FROM (SELECT case_id, source, confidence, coalesce(nullif(trim(fragment), ''), signal) AS fragment, signal AS explanation, time_s FROM hits QUALIFY row_number() OVER (PARTITION BY case_id, source ORDER BY confidence DESC, lane, seg_no, rule_ord, pos, signal DESC) = 1)"))
def _(t):
    """Per case and source what its strongest hit says, and when; the first one on ties."""
    hits = Scored(t).hits
    best = S.strongest(hits, "source", F.struct(F.col("time_s"), F.coalesce(F.nullif(F.trim("fragment"), F.lit("")), F.col("signal")).alias("fragment"), F.col("signal").alias("explanation"), F.col("confidence")))
    return best.select("case_id", "source", "best.time_s", "best.fragment", "best.explanation", "best.confidence")
