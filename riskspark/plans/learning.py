"""Queries of labels, augmentation, training and calibration."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions import text as T
from riskspark.operators import features as X
from riskspark.operators import learning as L
from riskspark.operators import metrics as E
from riskspark.operators import network as N
from riskspark.plans.base import query
from riskspark.operators.features import SLOTS
from riskspark.plans.scoring import CHAIN, FEATURED, Features, Scored, chain
from riskspark.session import drop, materialise
from riskspark.sources import cases as C
from riskspark.sources import intake as I
from riskspark.sources.fixtures import with_


class RawTexts:
    """Inputs whose posts are the documents' texts and nothing else."""

    def __init__(self, t):
        self.t = t

    def __getattr__(self, name):
        if name == "posts":
            empty, none = F.lit(""), F.lit(None).cast("string")
            return self.t.documents.select(F.col("doc_id").alias("case_id"), empty.alias("title"), F.col("text").alias("description"), empty.alias("tags"), none.alias("filename"), none.alias("provided_transcript"))
        found = getattr(self.t, name)
        return found.where(F.lit(False)) if name in ("segments", "ocr", "visual") else found


WEIGHT = "greatest(0.2::DOUBLE, least(1::DOUBLE, least(abs(score - 40), abs(score - 65), abs(score - 88)) / (CASE WHEN score < 40 THEN 20 WHEN score < 65 THEN 12.5 WHEN score < 88 THEN 11.5 ELSE 6 END)::DOUBLE))"


@query("ml1_weak_labels", chain("SELECT case_id, score / 100::DOUBLE AS risk, score >= 50 AS is_scam, category, profit / 100 AS profit FROM category"))
def _(t):
    return L.weak_labels(Scored(t).graded).select("case_id", "risk", "is_scam", "category", "profit")


@query("ml2_label_weight", with_("posts") + f"SELECT case_id, round({WEIGHT}, 6) AS weight FROM (SELECT case_id, (case_id % 101)::DOUBLE AS score FROM posts)")
def _(t):
    return t.posts.select("case_id", F.round(L.label_weight((F.col("case_id") % 101).cast("double")), 6).alias("weight"))


@query("ml2_weights_of_scores", chain(f"SELECT case_id, score, round({WEIGHT}, 6) AS weight FROM (SELECT case_id, score::DOUBLE AS score FROM overall)"))
def _(t):
    return Scored(t).scores.select("case_id", F.col("score").cast("double").alias("score"), F.round(L.label_weight(F.col("score").cast("double")), 6).alias("weight"))


THEMES = " + ".join(f"CAST({d} >= 40 AS INT)" for d in config.DIMENSIONS)


@query("ml20_graded_cases", chain(f"SELECT case_id, CASE WHEN NOT intent THEN 0.08::DOUBLE WHEN themes >= 4 THEN 0.95 WHEN themes = 3 THEN 0.86 WHEN themes = 2 THEN 0.74 ELSE 0.58 END AS risk FROM (SELECT case_id, coalesce(neg, 0) = 0 AND {THEMES} > 0 AS intent, {THEMES} AS themes FROM overall)"))
def _(t):
    """Intent: a case with a strong dimension and no warning of fraud; themes: its strong dimensions."""
    themes = sum(((F.col(d) >= 40).cast("int") for d in config.DIMENSIONS), F.lit(0))
    return Scored(t).scores.select("case_id", L.graded_risk((F.coalesce("neg", F.lit(0.0)) == 0) & (themes > 0), themes).alias("risk"))


# Raw texts as posts of their own, without speech, frames or links to media.
RAW = "SELECT doc_id AS case_id, '' AS title, text AS description, '' AS tags, CAST(NULL AS VARCHAR) AS filename, CAST(NULL AS VARCHAR) AS provided_transcript FROM documents"
RAW_CHAIN = CHAIN | {"posts": RAW} | {n: f"SELECT * FROM ({CHAIN[n]}) WHERE FALSE" for n in ("segments", "ocr", "visual")}


@query("ml3_label_texts", with_(**RAW_CHAIN) + "SELECT case_id, score / 100::DOUBLE AS risk, score >= 50 AS is_scam, category FROM category")
def _(t):
    return L.weak_labels(Scored(RawTexts(t)).graded).select("case_id", "risk", "is_scam", "category")


# Hand-made labels are those of the table ``labels``: how toxic a document was found, as risk and category; their dimensions come from the rules.
GOLD = "SELECT doc_id AS case_id, CASE WHEN toxic = 1 THEN 0.9::DOUBLE ELSE 0.05 END AS risk, toxic = 1 AS is_scam, CASE WHEN toxic = 1 THEN 'suspicious_other' ELSE 'no_violation' END AS category FROM labels WHERE toxic IS NOT NULL"
SHARES = ", ".join(f"{d} / 100 AS {d}" for d in config.DIMENSIONS)
LABELLED = {"gold": GOLD, "weak": f"SELECT case_id, score / 100::DOUBLE AS risk, score >= 50 AS is_scam, {WEIGHT} AS weight, category, {SHARES} FROM category", "merged": "SELECT case_id, risk, is_scam, weight, category, " + ", ".join(config.DIMENSIONS) + ", 'weak' AS source FROM weak WHERE case_id NOT IN (SELECT case_id FROM gold) UNION ALL SELECT case_id, g.risk, g.is_scam, 1.0::DOUBLE, g.category, " + ", ".join(f"coalesce({d}, 0)" for d in config.DIMENSIONS) + ", 'gold' FROM gold g LEFT JOIN weak w USING (case_id)"}


def labelled_sql(body):
    return with_(**CHAIN, **LABELLED) + body


def merged_labels(t):
    weak = materialise(L.weak_labels(Scored(t).graded))  # read twice
    risk = F.when(F.col("toxic") == 1, 0.9).otherwise(0.05)
    given = t.labels.where("toxic is not null").select(F.col("doc_id").alias("case_id"), risk.alias("risk"), (F.col("toxic") == 1).alias("is_scam"), F.when(F.col("toxic") == 1, "suspicious_other").otherwise("no_violation").alias("category"))
    return L.merge_labels(weak, L.hand_labels(given, weak))


@query("ml4_merge_labels", labelled_sql("SELECT case_id, source, round(risk, 6) AS risk, is_scam, category, round(weight, 6) AS weight, " + ", ".join(f"round({d}, 6) AS {d}" for d in config.DIMENSIONS) + " FROM merged"))
def _(t):
    m = merged_labels(t)
    return m.select("case_id", "source", F.round("risk", 6).alias("risk"), "is_scam", "category", F.round("weight", 6).alias("weight"), *[F.round(d, 6).alias(d) for d in config.DIMENSIONS])


INDEX = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(L.CATEGORY_NAMES)) + " ELSE 0 END"


# Cases on screen may lack a post, and so a label: they are in the table with zeros.
@query("ml5_training_table", labelled_sql(f"SELECT case_id, round(least(1, greatest(0, coalesce(risk, 0))), 6) AS y, " + ", ".join(f"round(least(1, greatest(0, coalesce({d}, 0))), 6) AS {d}" for d in config.DIMENSIONS) + f", {INDEX} AS category, round(greatest(0, coalesce(weight, 0)), 6) AS weight FROM (SELECT case_id FROM posts UNION SELECT case_id FROM ocr UNION SELECT case_id + 1000000 FROM ocr) LEFT JOIN merged USING (case_id)"))
def _(t):
    cases = t.posts.select("case_id").union(t.ocr.select("case_id")).union(t.ocr.select(F.col("case_id") + 1_000_000)).distinct()
    found = L.training_table(cases, merged_labels(t))
    return found.select("case_id", F.round("y", 6).alias("y"), *[F.round(d, 6).alias(d) for d in config.DIMENSIONS], "category", F.round("weight", 6).alias("weight"))


# The lines themselves, taken apart again by each engine's own JSON reader.
EXAMPLE = "json_object('id', case_id, 'features', json_object('lang_hint', lang_hint, 'num_segments', num_segments, 'link_telegram', link_telegram, 'behavior_count', behavior_count, 'kb_similarity', round(kb_similarity, 6)), 'label', json_object('risk', score / 100::DOUBLE, 'is_scam', score >= 50, 'category', category))"


@query("io19_export_examples", FEATURED + f"SELECT (l ->> '$.id')::BIGINT AS case_id, l ->> '$.features.lang_hint' AS lang_hint, (l ->> '$.features.num_segments')::BIGINT AS num_segments, (l ->> '$.features.link_telegram')::BIGINT AS link_telegram, (l ->> '$.features.behavior_count')::BIGINT AS behavior_count, (l ->> '$.features.kb_similarity')::DOUBLE AS kb_similarity, (l ->> '$.label.risk')::DOUBLE AS risk, (l ->> '$.label.is_scam')::BOOLEAN AS is_scam, l ->> '$.label.category' AS category FROM (SELECT {EXAMPLE} AS l FROM raw JOIN category USING (case_id))")
def _(t):
    s = Scored(t)
    lines = C.to_lines(C.examples(Features(s).raw, L.weak_labels(s.graded)))
    read = lines.select(F.from_json("line", "id BIGINT, features STRUCT<lang_hint: STRING, num_segments: BIGINT, link_telegram: BIGINT, behavior_count: BIGINT, kb_similarity: DOUBLE>, label STRUCT<risk: DOUBLE, is_scam: BOOLEAN, category: STRING>").alias("x"))
    f = F.col("x.features")
    return read.select(F.col("x.id").alias("case_id"), *[f[c].alias(c) for c in ("lang_hint", "num_segments", "link_telegram", "behavior_count")], F.round(f["kb_similarity"], 6).alias("kb_similarity"), "x.label.risk", "x.label.is_scam", "x.label.category")


@query("ml6_split_sizes", "SELECT lang, count(*) AS n, CAST(greatest(1, floor(count(*) * 0.15::DOUBLE)) AS BIGINT) AS held FROM documents GROUP BY 1")
def _(t):
    return L.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang").groupBy("lang").agg(F.count("*").alias("n"), F.count_if("held").alias("held"))


GRAM_ROWS = lambda t: t.posts.select("case_id", T.folded_words(F.col("description")).alias("w")).select("case_id", F.explode(T.word_ngrams(F.col("w"))).alias("gram"))
WIDTH = L.BUCKETS + len(SLOTS)


@query("ml7_hashed_features")
def _(t):
    return L.hashed_features(GRAM_ROWS(t)).withColumn("value", F.round("value", 6))


class Learned:
    """Vectors, weak labels and a model of all heads over the fixtures."""

    def __init__(self, t):
        self.t, self.s = t, Scored(t)

    @cached_property
    def rows(self):
        return materialise(L.with_slots(L.hashed_texts(self.t.posts.select("case_id", F.col("description").alias("text"))), Features(self.s).slots))

    @cached_property
    def labelled(self):
        weak = materialise(L.weak_labels(self.s.graded))  # read for the counts, the settled cells and the others
        split = materialise(L.stratified_split(weak, "case_id", "is_scam"))
        drop(weak)
        return split

    @cached_property
    def goals(self):
        return self.rows.join(L.targets(self.labelled).join(self.labelled.select("case_id", "held"), "case_id"), "case_id")

    @cached_property
    def model(self):
        """The network, with steps of 256 rows."""
        return N.train(self.goals, WIDTH, batch=256)

    @cached_property
    def linear(self):
        return L.train_heads(self.goals, WIDTH)

    @property
    def predictions(self):
        return L.predict(self.rows, self.model, WIDTH)


def shown(df):
    return df.withColumns({c: F.round(c, 4) for c in ("prob", "confidence") if c in df.columns})


@query("ml6_split_members")
def _(t):
    return L.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang")


@query("ml8_vectors")
def _(t):
    return Learned(t).rows.select("case_id", F.size("idx").alias("n"), F.round(F.aggregate("val", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def history(t, m):
    return t.spark.createDataFrame([(k, round(x, 6), k == m.best_epoch) for k, x in m.history], "epoch int, held_loss double, best boolean")


@query("ml9_hidden_layer")
def _(t):
    """What the hidden layer adds: held-out loss and ranking of the network beside the linear heads."""
    one = Learned(t)
    held = one.labelled.where("held").select("case_id", F.col("is_scam").cast("int").alias("y"))
    both = [L.predict(one.rows, m, WIDTH).join(held, "case_id").select("y", "prob", F.lit(n).alias("model"), F.lit(min(x for _, x in m.history)).alias("held_loss")) for n, m in (("network", one.model), ("linear", one.linear))]
    rows = materialise(both[0].unionByName(both[1]))
    return E.auroc(rows, "prob", ("model",)).join(rows.groupBy("model").agg(F.first("held_loss").alias("held_loss"), F.count("*").alias("n")), "model").select("model", F.round("auroc", 6).alias("auroc"), F.round("held_loss", 6).alias("held_loss"), "n")


@query("ml10_train_and_predict")
def _(t):
    return shown(Learned(t).predictions)


@query("ml10_history")
def _(t):
    return history(t, Learned(t).model)


@query("ml11_linear_baseline")
def _(t):
    one = Learned(t)
    return shown(L.predict(one.rows, one.linear, WIDTH))


@query("ml11_history")
def _(t):
    return history(t, Learned(t).linear)


@query("ml12_predictions")
def _(t):
    one = Learned(t)
    return shown(one.predictions).join(one.labelled.select("case_id", F.col("risk").alias("target"), "held"), "case_id")


@query("ml13_with_fallback")
def _(t):
    one = Learned(t)
    # Where a post has no words of its own there is nothing for a model to read: no prediction, and the rules stay.
    read = t.posts.where(T.has_words(F.col("description"))).select("case_id")
    return L.with_fallback(one.s.graded, one.predictions.join(read, "case_id", "left_semi"))


@query("ml16_isotonic")
def _(t):
    return L.isotonic(t.scored, "p_model").select("id", F.round("calibrated", 6).alias("calibrated"))


@query("ml17_attributions")
def _(t):
    one = Learned(t)
    top = X.text_ngrams(t.posts.select("case_id", F.col("description").alias("text")), 8).select("case_id", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "gram")).alias("pos"), "gram")
    tags = t.posts.select("case_id", F.posexplode(I.coerce_hashtags(F.col("tags"))).alias("p", "gram")).select("case_id", (100 + F.col("p")).alias("pos"), "gram")
    grams = top.unionByName(tags).select("case_id", "pos", "gram", L.bucket_of(F.col("gram")).alias("bucket"), L.sign_of(F.col("gram")).alias("sign"))
    return N.attributions(one.rows, one.model, grams, X.SLOTS, X.SLOT_DIMENSIONS).withColumn("weight", F.round("weight", 4))


@query("ml22_sampling_plan", "SELECT lang, n, least(n, min(n) OVER ()) AS quota, round(least(n, min(n) OVER ()) / n::DOUBLE, 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def _(t):
    return L.sampling_plan(t.documents.select("lang"), "lang").withColumn("share", F.round("share", 6))


@query("ml22_balanced_sample")
def _(t):
    docs = t.documents.select("doc_id", "lang")
    return L.balanced_sample(docs, "doc_id", "lang", L.sampling_plan(docs, "lang"))


@query("ml23_soft_targets")
def _(t):
    return L.soft_targets(Learned(t).predictions).select("case_id", F.round("risk", 4).alias("risk"), "is_scam", "category")


TEMPERED = "1 / (1 + exp(-ln(q / (1 - q)) / t))"


def bracket_sql(passes: int = 9, points: int = 16) -> str:
    """The same brackets in SQL, one pass after the other."""
    parts = ["b0 AS (SELECT 0.25::DOUBLE AS lo, 10::DOUBLE AS hi)"]
    for k in range(1, passes + 1):
        parts.append(f"g{k} AS (SELECT j, lo + (hi - lo) * j / {points + 1} AS t FROM b{k - 1}, (SELECT unnest(range({points + 2})) AS j))")
        parts.append(f"n{k} AS (SELECT j, any_value(t) AS t, sum(-pos * ln(p) - neg * ln(1 - p)) AS nll FROM (SELECT j, t, pos, neg, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {TEMPERED})) AS p FROM heaps, g{k}) GROUP BY 1)")
        parts.append(f"b{k} AS (SELECT max(CASE WHEN n.j = greatest(0, x.j - 1) THEN t END) AS lo, max(CASE WHEN n.j = least({points + 1}, x.j + 1) THEN t END) AS hi FROM n{k} n, (SELECT arg_min(j, nll) AS j FROM n{k}) x)")
    return ",\n".join(parts)


@query("ml14_temperature", with_("scored", heaps="SELECT greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p_model)) AS q, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1").rstrip() + ",\n" + bracket_sql() + f" SELECT round(any_value(t), 5) AS temperature, round(avg(-y * ln(p) - (1 - y) * ln(1 - p)), 6) AS nll FROM (SELECT y, t, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {TEMPERED})) AS p FROM (SELECT y, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p_model)) AS q FROM scored), (SELECT (lo + hi) / 2 AS t FROM b9))")
def _(t):
    return L.fit_temperature(t.scored, "p_model").select(F.round("temperature", 5).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("ml15_tempered", with_("scored") + f"SELECT id, round({TEMPERED}, 6) AS p FROM (SELECT id, 2.5::DOUBLE AS t, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, p_model)) AS q FROM scored)")
def _(t):
    return t.scored.select("id", F.round(L.tempered(F.col("p_model"), 2.5), 6).alias("p"))


@query("ml18_augmented", chain("SELECT case_id, score / 100::DOUBLE AS risk, score >= 50 AS is_scam, category, sha256(coalesce(description, '')) AS text FROM category JOIN (SELECT case_id, description FROM posts) USING (case_id)"))
def _(t):
    """The parents among the augmented rows are the labelled posts, as they were."""
    return _augmented(t).where("not twin").select("case_id", "risk", "is_scam", "category", F.sha2("text", 256).alias("text"))


def _augmented(t):
    labels = L.weak_labels(Scored(t).graded)
    texts = t.posts.select("case_id", F.coalesce("description", F.lit("")).alias("text"))
    return L.augmented(labels.join(texts, "case_id"), F.col("is_scam"))


@query("ml18_obfuscated_twins")
def _(t):
    return _augmented(t).where("twin").select("case_id", "risk", "is_scam", "category", F.sha2("text", 256).alias("twin"))


@query("ml19_codemix", with_("posts") + "SELECT case_id, sha256(CASE WHEN case_id % 3 = 0 THEN concat_ws(' ', description, CASE case_id % 2 WHEN 0 THEN 'join now' ELSE 'тез келіңіз' END) ELSE description END) AS v FROM posts")
def _(t):
    return t.posts.select("case_id", F.sha2(L.codemix(F.col("description"), F.col("case_id"), ("join now", "тез келіңіз")), 256).alias("v"))


@query("ml20_graded_risk", with_("posts") + "SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 0.08::DOUBLE WHEN case_id % 6 >= 4 THEN 0.95 WHEN case_id % 6 = 3 THEN 0.86 WHEN case_id % 6 = 2 THEN 0.74 ELSE 0.58 END AS risk FROM posts")
def _(t):
    return t.posts.select("case_id", L.graded_risk(F.col("case_id") % 3 != 0, F.col("case_id") % 6).alias("risk"))


@query("ml21_surface_dedup", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text || chr(31) || lang)")
def _(t):
    return L.surface_dedup(t.documents, "doc_id", "text", "lang").select("doc_id", "n")


# ---- model and rules on the same held-out rows ------------------------------------------------------------------------
def held_out(t, one=None):
    """``id, y, p_model, p_rule, obfuscated`` and category indices of the held-out cases that the table ``labels`` knows: real predictions of the network beside the rules."""
    one = one or Learned(t)
    index = lambda c: F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(L.CATEGORY_NAMES) for x in (n, k)]), F.col(c))
    rules = one.s.graded.select("case_id", (F.col("score") / 100).alias("p_rule"), index("category").alias("category"))
    guess = one.predictions.select("case_id", F.col("prob").alias("p_model"), index("category").alias("category_pred"), *[F.col(d).alias(f"guess_{d}") for d in config.DIMENSIONS])
    truth = t.labels.where("toxic is not null").groupBy(F.col("doc_id").alias("case_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    texts = t.posts.select("case_id", T.looks_obfuscated(F.col("description")).alias("obfuscated"))
    held = one.labelled.where("held").select("case_id")
    return materialise(held.join(truth, "case_id").join(rules, "case_id").join(guess, "case_id").join(texts, "case_id").withColumnRenamed("case_id", "id"))


@query("ev15_model_and_rules")
def _(t):
    """All metrics of both predictors on the same held-out rows, by slice."""
    return E.sliced_metrics(held_out(t))


@query("ev15_held_out")
def _(t):
    """The rows themselves, for a review queue or other metrics."""
    return held_out(t).select("id", "y", F.round("p_model", 6).alias("p_model"), F.round("p_rule", 6).alias("p_rule"), "obfuscated", "category", "category_pred")


@query("ev16_summary")
def _(t):
    """Training in one row: sizes, share of positives, best epoch and its loss, temperature, and the mean error of each dimension on held-out cases."""
    one = Learned(t)
    held = one.labelled.where("held")
    guess = one.predictions.select("case_id", *[(F.col(d) / 100).alias(f"guess_{d}") for d in config.DIMENSIONS])
    errors = [F.avg(F.abs(F.col(d) - F.col(f"guess_{d}"))).alias(f"mae_{d}") for d in config.DIMENSIONS]
    found = held.join(guess, "case_id").agg(*errors, F.count("*").alias("n_held"))
    sizes = one.labelled.agg(F.count("*").alias("n"), F.avg(F.col("is_scam").cast("double")).alias("positive_share"))
    best = dict(one.model.history)[one.model.best_epoch]
    mean = sum((F.col(f"mae_{d}") for d in config.DIMENSIONS), F.lit(0.0)) / len(config.DIMENSIONS)
    one_row = sizes.crossJoin(found).withColumn("mae_mean", mean)  # one row each
    return one_row.select("n", "n_held", F.round("positive_share", 6).alias("positive_share"), F.lit(one.model.best_epoch).alias("best_epoch"), F.lit(round(best, 6)).alias("held_loss"), F.round("mae_mean", 4).alias("mae_mean"), *[F.round(f"mae_{d}", 4).alias(f"mae_{d}") for d in config.DIMENSIONS])
