"""Queries of metrics, drift, review queue and dashboard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions import text as X
from riskspark.operators import metrics as E
from riskspark.operators.features import SLOTS
from riskspark.plans.base import query
from riskspark.plans.intake import BY_HOST, HOST, VALID
from riskspark.plans.scoring import CHAIN, FEATURED, SLOT_SQL, Features, Scored, chain
from riskspark.session import materialise
from riskspark.sources import intake as I
from riskspark.sources.fixtures import SQL, values, with_

W = with_("scored")
R = lambda c, n=6: F.round(c, n).alias(c)


def rounded(df, *keep):
    return df.select(*keep, *[R(c) for c in df.columns if c not in keep])


def auroc_sql(src, p, keys=""):
    k, part = (keys + ", ") if keys else "", f"PARTITION BY {keys}" if keys else ""
    return f"SELECT {k}CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.5 ELSE sum(pos * (under + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) END AS auroc FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM (SELECT {k}{p} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY ALL)){' GROUP BY ' + keys if keys else ''}"


def ap_sql(src, p, keys=""):
    k, part = (keys + ", ") if keys else "", f"PARTITION BY {keys}" if keys else ""
    return f"SELECT {k}CASE WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * tp / n::DOUBLE) / sum(pos) END AS ap FROM (SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(pos + neg) OVER ({part} ORDER BY s DESC) AS n FROM (SELECT {k}{p} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY ALL)){' GROUP BY ' + keys if keys else ''}"


def cls_sql(src, p, keys=""):
    k = (keys + ", ") if keys else ""
    return f"""SELECT {k}n, (n - fp - fn) / n::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, brier FROM
 (SELECT {k}sum(CASE WHEN {p} >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN {p} >= 0.5 THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN {p} < 0.5 THEN y ELSE 0 END) AS fn, count(*) AS n, avg(({p} - y) ** 2) AS brier FROM {src}{' GROUP BY ' + keys if keys else ''})"""


def r6(sql, *cols, keep=""):
    return f"SELECT {keep + ', ' if keep else ''}{', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM ({sql})"


@query("ev1_auroc", W + r6(auroc_sql("scored", "p_model"), "auroc"))
def _(t):
    return rounded(E.auroc(t.scored, "p_model"))


@query("ev2_average_precision", W + r6(ap_sql("scored", "p_model"), "ap"))
def _(t):
    return rounded(E.average_precision(t.scored, "p_model"))


@query("ev3_classification", W + r6(cls_sql("scored", "p_model"), "accuracy", "precision", "recall", "f1", "brier", keep="n"))
def _(t):
    return rounded(E.classification(t.scored, "p_model"), "n")


@query("ev4_calibration_error", W + "SELECT round(sum(n * abs(h - p)) / sum(n), 6) AS ece FROM (SELECT greatest(0, ceil(p_model * 15) - 1) AS bin, count(*) AS n, avg(y) AS h, avg(p_model) AS p FROM scored GROUP BY 1)")
def _(t):
    return rounded(E.calibration_error(t.scored, "p_model"))


@query("ev5_reliability", W + "SELECT r.bin, coalesce(n, 0) AS n, round(coalesce(p, 0), 6) AS p, round(coalesce(hit, 0), 6) AS hit FROM (SELECT unnest(range(15)) AS bin) r LEFT JOIN (SELECT CAST(least(14, floor(p_rule * 15)) AS BIGINT) AS bin, count(*) AS n, avg(p_rule) AS p, avg(y) AS hit FROM scored GROUP BY 1) s USING (bin)")
def _(t):
    return rounded(E.reliability(t.scored, "p_rule"), "bin", "n")


@query("ev6_error_and_correlation", W + "SELECT category, round(avg(abs(p_model - p_rule)), 6) AS mae, round(coalesce(corr(p_model, p_rule), 0), 6) AS r FROM scored GROUP BY 1")
def _(t):
    return rounded(E.error_and_correlation(t.scored, "category", "p_model", "p_rule"), "category")


@query("ev7_threshold_at_fpr", W + "SELECT round(quantile_cont(p_model, 0.9), 6) AS threshold FROM scored WHERE y = 0")
def _(t):
    return rounded(E.threshold_at_fpr(t.scored, "p_model"))


@query("ev8_rates_at_threshold", W + "SELECT round(avg(CASE WHEN y = 1 THEN CAST(p_model >= h AS INT) END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN CAST(p_model >= h AS INT) END), 6) AS fpr FROM scored, (SELECT quantile_cont(p_model, 0.9) AS h FROM scored WHERE y = 0)")
def _(t):
    at = t.scored.crossJoin(F.broadcast(E.threshold_at_fpr(t.scored, "p_model")))
    return rounded(at.agg(*E.rates_at(at, "p_model", F.col("threshold"))))


@query("ev9_operating_points", W + "SELECT band, round(avg(CASE WHEN y = 1 THEN CAST(p_model >= band / 100 AS INT) END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN CAST(p_model >= band / 100 AS INT) END), 6) AS fpr FROM scored, (SELECT unnest([40.0, 65.0, 88.0])::DOUBLE AS band) GROUP BY 1")
def _(t):
    return rounded(E.operating_points(t.scored, "p_model"), "band")


SLICED = "SELECT slice, predictor, y, CASE predictor WHEN 'model' THEN p_model ELSE p_rule END AS p FROM scored, (SELECT unnest(['all', 'clean', 'obfuscated']) AS slice), (SELECT unnest(['model', 'rules']) AS predictor) WHERE slice = 'all' OR (slice = 'obfuscated') = obfuscated"


@query("ev10_slices", with_("scored", sliced=SLICED) + "SELECT slice, predictor, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "brier", "auroc", "ap")) + f" FROM ({cls_sql('sliced', 'p', 'slice, predictor')}) JOIN ({auroc_sql('sliced', 'p', 'slice, predictor')}) USING (slice, predictor) JOIN ({ap_sql('sliced', 'p', 'slice, predictor')}) USING (slice, predictor)")
def _(t):
    return rounded(E.sliced_metrics(t.scored), "slice", "predictor", "n")


METRICS = ("accuracy", "precision", "recall", "f1", "brier", "auroc", "ap")


@query("ev10_delta", with_("scored", sliced=SLICED, m=f"SELECT slice, predictor, {', '.join(METRICS)} FROM ({cls_sql('sliced', 'p', 'slice, predictor')}) JOIN ({auroc_sql('sliced', 'p', 'slice, predictor')}) USING (slice, predictor) JOIN ({ap_sql('sliced', 'p', 'slice, predictor')}) USING (slice, predictor)") + "SELECT a.slice, " + ", ".join(f"round(a.{c} - b.{c}, 6) AS {c}" for c in METRICS) + " FROM m a JOIN m b USING (slice) WHERE a.predictor = 'model' AND b.predictor = 'rules'")
def _(t):
    return rounded(E.sliced_delta(t.scored), "slice")


# The eight dimensions before and after the knowledge base has its say, as two readings of the same cases.
@query("ev6_dimensions", chain("SELECT a.dim, round(avg(abs(a.value - b.value)), 6) AS mae, round(CASE WHEN stddev_pop(a.value) < 1e-12 OR stddev_pop(b.value) < 1e-12 THEN 0 ELSE corr(a.value, b.value) END, 6) AS r FROM dim_rows a JOIN boosted b USING (case_id, dim) GROUP BY 1"))
def _(t):
    s = Scored(t)
    pairs = s.dims.select("case_id", "dim", F.col("value").cast("double").alias("truth")).join(s.boosted.select("case_id", "dim", F.col("value").cast("double").alias("guess")), ["case_id", "dim"])
    return rounded(E.error_and_correlation(pairs, "dim", "truth", "guess"), "dim")


INSIDE = "p_model >= 0.4 AND p_model <= 0.6"
WRONG = "CAST((CASE WHEN p_model >= 0.5 THEN 1 ELSE 0 END) <> y AS INT)"


@query("ev11_uncertainty", W + f"SELECT round(avg(CAST({INSIDE} AS INT)), 6) AS share, round(coalesce(avg(CASE WHEN {INSIDE} THEN {WRONG} END), 0), 6) AS inside, round(coalesce(avg(CASE WHEN NOT ({INSIDE}) THEN {WRONG} END), 0), 6) AS outside FROM scored")
def _(t):
    return rounded(E.uncertainty(t.scored, "p_model"))


@query("ev12_agreement", W + "SELECT round(avg(CAST(m = y AS INT)), 6) AS model_truth, round(avg(CAST(r = y AS INT)), 6) AS rule_truth, round(avg(CAST(m = r AS INT)), 6) AS model_rule FROM (SELECT y, CAST(p_model >= 0.5 AS INT) AS m, CAST(p_rule >= 0.5 AS INT) AS r FROM scored)")
def _(t):
    return rounded(E.agreement(t.scored))


@query("ev13_category_accuracy", W + "SELECT round(avg(CAST(category = category_pred AS INT)), 6) AS accuracy FROM scored WHERE category > 0")
def _(t):
    return rounded(t.scored.where("category > 0").agg(F.avg((F.col("category") == F.col("category_pred")).cast("double")).alias("accuracy")))


@query("ev14_counts", W + "SELECT count(*) AS n, sum(y)::BIGINT AS n_positive, sum(1 - y)::BIGINT AS n_benign, count(*) FILTER (obfuscated) AS n_obfuscated FROM scored")
def _(t):
    return t.scored.agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), F.sum(1 - F.col("y")).alias("n_benign"), F.count_if("obfuscated").alias("n_obfuscated"))


@query("ev15_both_predictors", chain("SELECT case_id, score, toxic FROM overall JOIN labels ON doc_id = case_id"))
def _(t):
    return Scored(t).scores.join(t.labels, F.col("case_id") == F.col("doc_id")).select("case_id", "score", "toxic")


@query("ev16_training_summary", W + "SELECT round(avg(y), 6) AS positive_share, round(avg(abs(p_model - y)), 6) AS mae, count(*) AS n FROM scored")
def _(t):
    return t.scored.agg(F.round(F.avg("y"), 6).alias("positive_share"), F.round(F.avg(F.abs(F.col("p_model") - F.col("y"))), 6).alias("mae"), F.count("*").alias("n"))


@query("wn12_uncertain", W + "SELECT id, round(0.5 - abs(p_model - 0.5), 6) AS uncertainty FROM scored ORDER BY p_model >= 0.4 AND p_model <= 0.6 DESC, abs(p_model - 0.5), id LIMIT 50")
def _(t):
    flagged = (F.col("p_model") >= 0.4) & (F.col("p_model") <= 0.6)
    return t.scored.orderBy(F.desc(flagged), F.abs(F.col("p_model") - 0.5), "id").limit(50).select("id", F.round(0.5 - F.abs(F.col("p_model") - 0.5), 6).alias("uncertainty"))


@query("io18_review_queue", W + "SELECT id, round(p_model, 6) AS p_model, round(0.5 - abs(p_model - 0.5), 6) AS uncertainty FROM scored WHERE p_model >= 0.4 AND p_model <= 0.6")
def _(t):
    from riskspark.sources.cases import to_lines

    lines = to_lines(t.scored.where("p_model >= 0.4 and p_model <= 0.6").select("id", "p_model", (0.5 - F.abs(F.col("p_model") - 0.5)).alias("uncertainty")))
    return rounded(lines.select(F.from_json("line", "id BIGINT, p_model DOUBLE, uncertainty DOUBLE").alias("x")).select("x.*"), "id")


@query("io20_metrics_document", W + f"SELECT n, accuracy, f1, auroc, ap FROM ({r6(cls_sql('scored', 'p_model'), 'accuracy', 'f1', keep='n')}), ({r6(auroc_sql('scored', 'p_model'), 'auroc')}), ({r6(ap_sql('scored', 'p_model'), 'ap')})")
def _(t):
    from riskspark.sources.cases import metrics_document

    one = metrics_document({"classification": E.classification(t.scored, "p_model"), "ranking": E.auroc(t.scored, "p_model").crossJoin(E.average_precision(t.scored, "p_model"))})
    found = one.select(F.from_json("document", "classification STRUCT<n: BIGINT, accuracy: DOUBLE, f1: DOUBLE>, ranking STRUCT<auroc: DOUBLE, ap: DOUBLE>").alias("d"))
    return rounded(found.select("d.classification.*", "d.ranking.*"), "n")


DRIFT = """WITH v AS (SELECT event_type AS k, value AS v, ts < TIMESTAMP '2024-01-16' AS base FROM events), e AS (SELECT k, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE base GROUP BY 1),
p AS (SELECT k, len(list_filter(edges, lambda x: x < v)) AS bin, base FROM v JOIN e USING (k)), c AS (SELECT k, bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c FROM p GROUP BY 1, 2), a AS (SELECT k, unnest(range(len(edges) + 1)) AS bin FROM e),
s AS (SELECT k, greatest(coalesce(b, 0) / sum(coalesce(b, 0)) OVER (PARTITION BY k), 1e-4) AS b, greatest(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY k), 1e-4) AS c FROM a LEFT JOIN c USING (k, bin)), n AS (SELECT k, b / sum(b) OVER (PARTITION BY k) AS b, c / sum(c) OVER (PARTITION BY k) AS c FROM s),
psi AS (SELECT k, sum((c - b) * ln(c / b)) AS psi FROM n GROUP BY 1)
"""


def _events(t):
    return t.events.select(F.col("event_type").alias("k"), F.col("value").alias("v"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("base"))


@query("ml24_baseline", "SELECT event_type AS k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi, min(value) = max(value) AS constant FROM events GROUP BY 1")
def _(t):
    e = t.events
    return e.groupBy(F.col("event_type").alias("k")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.min("value") == F.max("value")).alias("constant"))


@query("ml24_bins", """WITH v AS (SELECT event_type AS k, value AS v FROM events), e AS (SELECT k, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v GROUP BY 1),
c AS (SELECT k, len(list_filter(edges, lambda x: x < v)) AS bin, count(*) AS n FROM v JOIN e USING (k) GROUP BY 1, 2), a AS (SELECT k, edges, unnest(range(len(edges) + 1)) AS bin FROM e)
SELECT k, bin::INT AS bin, round(edges[bin + 1], 6) AS edge, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k), 6) AS share FROM a LEFT JOIN c USING (k, bin)""")
def _(t):
    return rounded(E.baseline_bins(t.events.select(F.col("event_type").alias("k"), F.col("value").cast("double").alias("v")), "k", "v"), "k", "bin")


@query("ml25_psi", DRIFT + "SELECT k, round(psi, 6) AS psi FROM psi")
def _(t):
    return rounded(E.psi(_events(t), F.col("base"), "k", "v"), "k")


@query("ml26_drift_report", DRIFT + "SELECT count(*) FILTER (psi > 0.2) AS flagged, round(max(psi), 6) AS worst, round(avg(psi), 6) AS mean FROM psi")
def _(t):
    return E.psi(_events(t), F.col("base"), "k", "v").agg(F.count_if(F.col("psi") > 0.2).alias("flagged"), F.round(F.max("psi"), 6).alias("worst"), F.round(F.avg("psi"), 6).alias("mean"))


@query("ml26_top_features", DRIFT + "SELECT k AS feature, round(psi, 6) AS psi, psi > 0.2 AS flagged FROM psi ORDER BY psi DESC, k LIMIT 15")
def _(t):
    top = E.psi(_events(t), F.col("base"), "k", "v").orderBy(F.desc("psi"), "k").limit(15)
    return top.select(F.col("k").alias("feature"), F.round("psi", 6).alias("psi"), (F.col("psi") > 0.2).alias("flagged"))


# ---- drift of the model's features: a baseline is stored from the cases of the first half of the month, later cases are held against it
LONG_SLOTS = "SELECT case_id, " + ", ".join(f"round(({x})::DOUBLE, 6) AS s{k}" for k, x in enumerate(SLOT_SQL)) + " FROM raw"
SLOT_DRIFT = (
    FEATURED.rstrip() + f""",\nslots AS ({LONG_SLOTS}), cells AS (SELECT created < DATE '2024-01-15' AS base, unnest([{', '.join(f"{{'k': '{n}', 'v': s{k}}}" for k, n in enumerate(SLOTS))}]) AS x FROM slots JOIN (SELECT case_id, created FROM posts) USING (case_id)),
v AS (SELECT x.k AS k, x.v AS v, base FROM cells), e AS (SELECT k, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi FROM v WHERE base GROUP BY 1),
p AS (SELECT k, len(list_filter(edges, lambda x: x < v)) AS bin, base FROM v JOIN e USING (k)), c AS (SELECT k, bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c FROM p GROUP BY 1, 2), a AS (SELECT k, edges, unnest(range(len(edges) + 1)) AS bin FROM e),
h AS (SELECT k, bin, edges[bin + 1] AS edge, coalesce(b, 0) / sum(coalesce(b, 0)) OVER (PARTITION BY k) AS b, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY k) AS c FROM a LEFT JOIN c USING (k, bin)),
n AS (SELECT k, greatest(b, 1e-4) / sum(greatest(b, 1e-4)) OVER (PARTITION BY k) AS b, greatest(c, 1e-4) / sum(greatest(c, 1e-4)) OVER (PARTITION BY k) AS c FROM h),
psi AS (SELECT k AS feature, sum((c - b) * ln(c / b)) AS psi FROM n GROUP BY 1)
"""
)


def _slot_drift(t):
    """The stored baseline and the later cases' values."""
    slots = Features(Scored(t)).slots
    rounded_slots = slots.select("case_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in slots.columns if c != "case_id"])
    both = materialise(rounded_slots.join(t.posts.select("case_id", (F.col("created") < F.lit("2024-01-15").cast("date")).alias("base")), "case_id"))
    parts = [E.slot_values(both.where(F.col("base") == early).drop("base"), SLOTS) for early in (True, False)]
    return materialise(E.drift_baseline(parts[0])), parts[1]


@query("ml24_slot_baseline", SLOT_DRIFT + "SELECT k AS feature, bin::INT AS bin, round(edge, 6) AS edge, round(b, 6) AS share, round(mean, 6) AS mean, round(std, 6) AS std, lo, hi, hi - lo < 1e-12 AS constant FROM h JOIN (SELECT k, mean, std, lo, hi FROM e) USING (k)")
def _(t):
    base, _ = _slot_drift(t)
    return base.select("feature", F.posexplode("shares").alias("bin", "share"), "edges", "mean", "std", "lo", "hi", "constant").select("feature", "bin", F.round(F.try_element_at("edges", F.col("bin") + 1), 6).alias("edge"), R("share"), R("mean"), R("std"), "lo", "hi", "constant")


@query("ml25_slot_psi", SLOT_DRIFT + "SELECT feature, round(psi, 6) AS psi FROM psi")
def _(t):
    return E.psi_to(*_slot_drift(t)).select("feature", R("psi"))


@query("ml26_slot_report", SLOT_DRIFT + "SELECT row_number() OVER (ORDER BY psi DESC, feature)::INT AS rank, feature, round(psi, 6) AS psi, psi > 0.2 AS flagged, n_flagged, round(worst, 6) AS worst, round(mean, 6) AS mean FROM (SELECT feature, round(psi, 9) AS psi FROM psi), (SELECT count(*) FILTER (psi > 0.2) AS n_flagged, max(psi) AS worst, avg(psi) AS mean FROM psi) ORDER BY 1 LIMIT 15")
def _(t):
    psi = E.psi_to(*_slot_drift(t)).withColumn("psi", F.round("psi", 9))
    return rounded(E.drift_report(psi), "rank", "feature", "flagged", "n_flagged")


# ---- scalar functions on what the pipeline computes ----------------------------------------------------------------------
MINUTES = "CAST(round_even(greatest(time_s, 0), 0) AS BIGINT)"


@query("tx9_hit_times", chain(f"SELECT case_id, time_s, lpad(CAST({MINUTES} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({MINUTES} % 60 AS VARCHAR), 2, '0') AS long_form, CAST({MINUTES} // 60 AS VARCHAR) || ':' || lpad(CAST({MINUTES} % 60 AS VARCHAR), 2, '0') AS short_form, count(*) AS n FROM hits WHERE time_s IS NOT NULL GROUP BY ALL"))
def _(t):
    timed = Scored(t).hits.where("time_s is not null").groupBy("case_id", "time_s").agg(F.count("*").alias("n"))
    return timed.select("case_id", "time_s", X.clock(F.col("time_s")).alias("long_form"), X.short_clock(F.col("time_s")).alias("short_form"), "n")


LEVELS = "CASE WHEN {0} >= 88 THEN 'critical' WHEN {0} >= 65 THEN 'high' WHEN {0} >= 40 THEN 'medium' ELSE 'low' END"


@query("tx10_component_levels", chain("SELECT case_id, part, CAST(least(100, greatest(0, round_even(v, 0))) AS INTEGER) AS score, " + LEVELS.format("v") + " AS level FROM (SELECT case_id, x.part AS part, x.v AS v FROM (SELECT case_id, unnest([{'part': 'text_speech', 'v': text_speech}, {'part': 'metadata_links', 'v': metadata_links}, {'part': 'behavior', 'v': behavior}, {'part': 'overall', 'v': overall}]) AS x FROM overall))"))
def _(t):
    """Clamping and levels (tx10, tx11) of every component and of the unrounded score."""
    names = ("text_speech", "metadata_links", "behavior", "overall")
    each = Scored(t).scores.select("case_id", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("v")) for n in names])).alias("x")).select("case_id", "x.*")
    return each.select("case_id", "part", X.clamp(F.col("v")).alias("score"), X.risk_level(F.col("v")).alias("level"))


@query("tx12_hit_severity", chain("SELECT case_id, source, CASE WHEN confidence >= 85 THEN 'critical' WHEN confidence >= 65 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN confidence >= 85 THEN 3 WHEN confidence >= 65 THEN 2 WHEN confidence >= 45 THEN 1 ELSE 0 END AS rank, count(*) AS n FROM hits GROUP BY 1, 2, 3, 4"))
def _(t):
    return Scored(t).hits.groupBy("case_id", "source", X.severity(F.col("confidence")).alias("severity"), X.severity_rank(F.col("confidence")).alias("rank")).agg(F.count("*").alias("n"))


# ---- dashboard -------------------------------------------------------------------------------------------------------
STATUS = "CASE case_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'review' ELSE 'closed' END"
BOARD = chain("").rstrip() + ",\nboard AS (SELECT o.case_id, score, level, category, created, " + STATUS + f" AS status, coalesce(title, '') AS title, CASE WHEN platform IN {VALID} THEN platform {BY_HOST} ELSE 'Instagram' END AS platform FROM category o JOIN (SELECT case_id, created, title, platform, {HOST} AS h FROM posts) USING (case_id))\n"


def _board(t, s=None):
    status = F.when(F.col("case_id") % 3 == 0, "new").when(F.col("case_id") % 3 == 1, "review").otherwise("closed")
    posts = t.posts.select("case_id", "created", F.coalesce("title", F.lit("")).alias("title"), I.resolve_platform(F.col("platform"), F.col("url")).alias("platform"))
    return (s or Scored(t)).graded.select("case_id", "score", "level", "category").join(posts, "case_id").withColumn("status", status)


LEVEL_NAMES = [("critical", "Критический", "Critical"), ("high", "Высокий", "High"), ("medium", "Средний", "Medium"), ("low", "Низкий", "Low")]
STATUS_NAMES = [("new", "Новый", "New"), ("review", "На проверке", "In review"), ("closed", "Закрыт", "Closed")]
SOURCE_NAMES = [("Metadata", "Метаданные", "Metadata"), ("Audio", "Аудио", "Audio"), ("OCR", "Текст в кадре", "On-screen text"), ("Visual", "Видеоряд", "Visual"), ("Behavior", "Поведение", "Behavior")]


def named(df, column, names):
    """``df`` with the names of a code in both languages; a code without one keeps itself."""
    known = df.sparkSession.createDataFrame(names, f"{column} string, {column}_ru string, {column}_en string")
    return df.join(F.broadcast(known), column, "left").withColumns({f"{column}_{lang}": F.coalesce(f"{column}_{lang}", column) for lang in ("ru", "en")})  # a handful of rows


def names_sql(column, names):
    return f"(SELECT * FROM {values(names, f'{column}, {column}_ru, {column}_en')})"


@query("tx26_labels", BOARD + f"SELECT case_id, level_ru, level_en, status_ru, status_en FROM board LEFT JOIN {names_sql('level', LEVEL_NAMES)} USING (level) LEFT JOIN {names_sql('status', STATUS_NAMES)} USING (status)")
def _(t):
    return named(named(_board(t), "level", LEVEL_NAMES), "status", STATUS_NAMES).select("case_id", "level_ru", "level_en", "status_ru", "status_en")


@query("tx26_source_labels", chain(f"SELECT case_id, source_ru, source_en, count(*) AS n FROM hits LEFT JOIN {names_sql('source', SOURCE_NAMES)} USING (source) GROUP BY 1, 2, 3"))
def _(t):
    return named(Scored(t).hits.select("case_id", "source"), "source", SOURCE_NAMES).groupBy("case_id", "source_ru", "source_en").agg(F.count("*").alias("n"))


def filter_queue(board, text=None, level=None, status=None, platform=None):
    """Optional conditions, all of which must hold."""
    if text:
        board = board.where(F.contains(F.lower("title"), F.lit(text.lower())))
    for column, value in (("level", level), ("status", status), ("platform", platform)):
        if value:
            board = board.where(F.col(column) == value)
    return board


@query("db1_queue", BOARD + "SELECT case_id, score, level FROM board WHERE contains(lower(title), 'the') AND status = 'review'")
def _(t):
    return filter_queue(_board(t), "The", status="review").select("case_id", "score", "level")


@query("db1_shown", BOARD + "SELECT count(*) FILTER (status = 'review' AND platform = 'Instagram') AS shown, count(*) AS total FROM board")
def _(t):
    # Conditions as an aggregate, so that shown and total are one pass over the board.
    return _board(t).agg(F.count_if((F.col("status") == "review") & (F.col("platform") == "Instagram")).alias("shown"), F.count("*").alias("total"))


NEW, OLD = "created >= DATE '2024-01-22'", "created < DATE '2024-01-22' AND created >= DATE '2024-01-15'"
KPIS = {"analysed": "TRUE", "high": "score >= 65", "review": "status = 'review'"}


@query("db2_kpis", BOARD + ", seen AS (SELECT b.*, cluster FROM board b LEFT JOIN kb USING (case_id)) SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}, count(*) FILTER ({c} AND {NEW}) - count(*) FILTER ({c} AND {OLD}) AS {n}_delta" for n, c in KPIS.items()) + f", count(DISTINCT cluster) FILTER (cluster <> 'isolated') AS clusters, count(DISTINCT cluster) FILTER (cluster <> 'isolated' AND {NEW}) - count(DISTINCT cluster) FILTER (cluster <> 'isolated' AND {OLD}) AS clusters_delta FROM seen")
def _(t):
    s = Scored(t)
    seen = _board(t, s).join(s.kb.select("case_id", F.nullif("cluster", F.lit("isolated")).alias("cluster")), "case_id", "left")
    new, old = F.expr(NEW), F.expr(OLD)
    counts = [x for n, c in KPIS.items() for x in (F.count_if(F.expr(c)).alias(n), (F.count_if(F.expr(c) & new) - F.count_if(F.expr(c) & old)).alias(f"{n}_delta"))]
    clusters = lambda when: F.count_distinct(F.when(when, F.col("cluster")))
    return seen.agg(*counts, clusters(F.lit(True)).alias("clusters"), (clusters(new) - clusters(old)).alias("clusters_delta"))


@query("db3_daily_trend", BOARD + "SELECT created, count(*) AS analysed, count(*) FILTER (score >= 65) AS high, count(*) FILTER (score >= 40) AS flagged FROM board GROUP BY 1")
def _(t):
    return _board(t).groupBy("created").agg(F.count("*").alias("analysed"), F.count_if(F.col("score") >= 65).alias("high"), F.count_if(F.col("score") >= 40).alias("flagged"))


@query("db4_category_share", BOARD + "SELECT category, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM board GROUP BY 1")
def _(t):
    n = _board(t).groupBy("category").agg(F.count("*").alias("n"))
    return n.select("category", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@query("db5_histogram", BOARD + "SELECT b.bucket, count(case_id) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS bucket) b LEFT JOIN board ON b.bucket = CAST(greatest(0, ceil(score / 20.0) - 1) AS INT) GROUP BY 1")
def _(t):
    n = _board(t).groupBy(F.greatest(F.lit(0), F.ceil(F.col("score") / 20) - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return t.spark.range(5).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(n), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("db6_timeline_counts", chain("SELECT source, CASE WHEN confidence >= 85 THEN 'critical' WHEN confidence >= 65 THEN 'high' WHEN confidence >= 45 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM hits WHERE time_s IS NOT NULL GROUP BY 1, 2"))
def _(t):
    from riskspark.functions.text import severity

    return Scored(t).hits.where("time_s is not null").groupBy("source", severity(F.col("confidence")).alias("severity")).agg(F.count("*").alias("n"))


DURATION = "SELECT p.case_id, coalesce(m.duration_s, s.x, f.x, 0) AS duration_s FROM posts p LEFT JOIN media m USING (case_id) LEFT JOIN (SELECT case_id, max(end_s) x FROM segments GROUP BY 1) s USING (case_id) LEFT JOIN (SELECT case_id, max(time_s) x FROM (SELECT case_id, time_s FROM ocr UNION ALL SELECT case_id, time_s FROM visual) GROUP BY 1) f USING (case_id)"


@query("db6_positions", with_(**CHAIN, media=SQL["media"], lengths=DURATION) + "SELECT h.case_id, source, signal, time_s, round(CASE WHEN duration_s > 0 THEN least(100, 100 * time_s / duration_s) ELSE 0 END, 6) AS percent FROM hits h JOIN lengths USING (case_id) WHERE time_s IS NOT NULL AND source = 'Audio'")
def _(t):
    timed = Scored(t).hits.where("time_s is not null and source = 'Audio'")
    lengths = I.resolve_duration(t.posts, t.media, t.segments, t.ocr, t.visual)
    percent = F.when(F.col("duration_s") > 0, F.least(F.lit(100.0), 100 * F.col("time_s") / F.col("duration_s"))).otherwise(0.0)
    return timed.join(lengths, "case_id").select("case_id", "source", "signal", "time_s", F.round(percent, 6).alias("percent"))


ACCOUNTS = "SELECT account, min(created) AS first_seen FROM (SELECT lower(value) AS account, created FROM links JOIN (SELECT case_id, created FROM posts) USING (case_id) WHERE kind = 'telegram') GROUP BY 1"


@query("db7_emerging_clusters", BOARD + f", accounts AS ({ACCOUNTS}), fresh AS (SELECT cluster, count(DISTINCT account) AS new_accounts FROM kb JOIN (SELECT case_id, lower(value) AS account FROM links WHERE kind = 'telegram') USING (case_id) JOIN accounts USING (account) WHERE first_seen >= DATE '2024-01-22' GROUP BY 1) SELECT cluster, count(*) AS matches, count(*) FILTER ({NEW}) AS recent, count(DISTINCT platform) AS platforms, round(avg(score), 6) AS mean_risk, coalesce(any_value(new_accounts), 0) AS new_accounts FROM kb JOIN board USING (case_id) LEFT JOIN fresh USING (cluster) WHERE cluster <> 'isolated' GROUP BY 1")
def _(t):
    s = Scored(t)
    mine = s.kb.where("cluster <> 'isolated'").select("case_id", "cluster")
    handles = s.links.where("kind = 'telegram'").select("case_id", F.lower("value").alias("account")).join(t.posts.select("case_id", "created"), "case_id")
    first = handles.groupBy("account").agg(F.min("created").alias("first_seen")).where("first_seen >= DATE '2024-01-22'")
    fresh = handles.join(first, "account").join(mine, "case_id").groupBy("cluster").agg(F.count_distinct("account").alias("new_accounts"))
    cases = mine.join(_board(t, s), "case_id").groupBy("cluster").agg(F.count("*").alias("matches"), F.count_if(F.expr(NEW)).alias("recent"), F.count_distinct("platform").alias("platforms"), F.round(F.avg("score"), 6).alias("mean_risk"))
    return cases.join(fresh, "cluster", "left").withColumn("new_accounts", F.coalesce("new_accounts", F.lit(0)))


@query("wn13_top_cases", BOARD + "SELECT case_id, score FROM board ORDER BY score DESC, case_id LIMIT 4")
def _(t):
    return _board(t).orderBy(F.desc("score"), "case_id").limit(4).select("case_id", "score")
