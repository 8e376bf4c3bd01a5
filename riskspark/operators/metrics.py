"""Evaluation metrics over (id, y, p) tables. Scores are collapsed to distinct values before any window runs over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.session import materialise


def by_score(df: DataFrame, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("neg"))


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``__cell``: ranges of about equal numbers of rows in the order of ``by``, written as they lie.

    Boundaries come from a sample of the column itself, not from its limits, so a heavy tail or scores crowded near 0 make no large range; the number of ranges is the session's
    number of shuffle partitions.  Rows that are equal in ``by`` share a range.
    """
    return materialise(df.repartitionByRange(*by).withColumn("__cell", F.spark_partition_id()))


def running(steps: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], down: bool = False) -> DataFrame:
    """Sums of ``columns`` over the scores before each row's (``before_...``), scores rising or falling.

    Rows lie in ranges of keys and scores.  Ranges are summed first (a row per key and range), then each range by itself, so no task
    sees all scores, however many are distinct.
    """
    way = F.desc if down else F.asc
    placed = ranged(steps, *keys, "p")
    sums = placed.groupBy(*keys, "__cell").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy(way("__cell")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__cell", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy(*keys, "__cell").orderBy(way("p")).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, [*keys, "__cell"])
    return joined.select(*steps.columns, *[(F.col(f"__{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{c}") for c in columns])


def auroc(df: DataFrame, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve with ties at half; 0.5 if one class is missing."""
    wins = running(by_score(df, p, keys), keys, ("neg",))
    total = wins.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("w"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return total.select(*keys, F.when((F.col("a") == 0) | (F.col("b") == 0), 0.5).otherwise(F.col("w") / (F.col("a").cast("double") * F.col("b"))).alias("auroc"))


def average_precision(df: DataFrame, p: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Step integral of precision over recall, tied scores together."""
    steps = running(by_score(df, p, keys), keys, ("pos", "neg"), down=True).withColumn("tp", F.col("before_pos") + F.col("pos"))
    n = F.col("tp") + F.col("before_neg") + F.col("neg")
    total = steps.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / n).alias("s"), F.sum("pos").alias("a"))
    return total.select(*keys, F.when(F.col("a") == 0, 0.0).otherwise(F.col("s") / F.col("a")).alias("ap"))


def quantiles(df: DataFrame, key: str, value: str, qs: list[float]) -> DataFrame:
    """``key, q, v``: exact quantiles per key, linear between neighbours.

    Distinct values lie in ranges of about equal numbers, with counts; only the ranges that hold a wanted rank are ordered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = ranged(counted, "k", "v").withColumnRenamed("__cell", "cell")
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("k", "cell").agg(F.sum("c").alias("in_cell")).withColumn("before", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    at = ranges.groupBy("k").agg(F.sum("in_cell").alias("n")).select("k", F.explode(F.array(*map(F.lit, qs))).alias("q"), "n").withColumn("at", F.col("q") * (F.col("n") - 1))
    ranks = at.select("k", "q", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    wanted = ranks.join(ranges, "k").where("rank >= before and rank < before + in_cell").select("k", "q", "at", "rank", "cell", "before")
    inside = Window.partitionBy("k", "cell").orderBy("v")
    ordered = placed.join(wanted.select("k", "cell", "before").distinct(), ["k", "cell"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    met = wanted.join(ordered.select("k", "cell", "v", (F.col("upto") - F.col("c")).alias("since"), "upto"), ["k", "cell"]).where("rank >= since and rank < upto")
    ends = met.groupBy("k", "q", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    return ends.select(F.col("k").alias(key), "q", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("v"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def classification(df: DataFrame, p: str, threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and Brier score in one aggregate."""
    yes, y = (F.col(p) >= threshold).cast("int"), F.col("y")
    n = df.groupBy(*keys).agg(F.sum(yes * y).alias("tp"), F.sum(yes * (1 - y)).alias("fp"), F.sum((1 - yes) * y).alias("fn"), F.count("*").alias("n"), F.avg(F.pow(F.col(p) - y, 2)).alias("brier"))
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(*keys, "n", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"), "brier")


def calibration_error(df: DataFrame, p: str, bins: int = config.ECE_BINS) -> DataFrame:
    """Expected calibration error over equal, right-closed bins."""
    binned = df.groupBy(F.greatest(F.lit(0), F.ceil(F.col(p) * bins) - 1).alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("hit"), F.avg(p).alias("p"))
    return binned.agg((F.sum(F.col("n") * F.abs(F.col("hit") - F.col("p"))) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, p: str, bins: int = config.ECE_BINS) -> DataFrame:
    """Left-closed bins with counts and means; empty bins are kept."""
    binned = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg("y").alias("hit"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(F.broadcast(binned), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("hit", F.lit(0.0)).alias("hit"))


def error_and_correlation(df: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Mean absolute error and Pearson correlation (0 for a constant side) per key."""
    flat = (F.stddev_pop(truth) < 1e-12) | (F.stddev_pop(guess) < 1e-12)
    return df.groupBy(key).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(truth, guess), F.stddev_pop(truth) * F.stddev_pop(guess)), F.lit(0.0))).alias("r"))


def threshold_at_fpr(df: DataFrame, p: str, target: float = 0.10) -> DataFrame:
    """The (1 - target) quantile of the negatives, linear."""
    return quantiles(df.where("y = 0").withColumn("__all", F.lit(0)), "__all", p, [1 - target]).select(F.col("v").alias("threshold"))


def rates_at(df: DataFrame, p: str, threshold: Column) -> tuple[Column, Column]:
    """Aggregates: recall and false positive rate at a threshold."""
    yes = F.col(p) >= threshold
    return F.coalesce(F.avg(F.when(F.col("y") == 1, yes.cast("double"))), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.when(F.col("y") == 0, yes.cast("double"))), F.lit(0.0)).alias("fpr")


def operating_points(df: DataFrame, p: str, bands: tuple[float, ...] = (40.0, 65.0, 88.0)) -> DataFrame:
    """Recall and false positive rate where score / 100 reaches each band."""
    each = df.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    return each.groupBy("band").agg(*rates_at(each, p, F.col("band") / 100))


def slices(df: DataFrame) -> DataFrame:
    """Each row under ``all`` and under its own slice, once per predictor: columns slice, predictor, y, p."""
    names = F.array(F.lit("all"), F.when(F.col("obfuscated"), "obfuscated").otherwise("clean"))
    models = F.array(F.struct(F.lit("model").alias("predictor"), F.col("p_model").alias("p")), F.struct(F.lit("rules").alias("predictor"), F.col("p_rule").alias("p")))
    return df.withColumn("slice", F.explode(names)).withColumn("m", F.explode(models)).select("slice", "m.predictor", "y", "m.p")


def sliced_metrics(df: DataFrame) -> DataFrame:
    """Metrics per slice and predictor."""
    s, keys = slices(df), ("slice", "predictor")
    return classification(s, "p", keys=keys).join(auroc(s, "p", keys), list(keys)).join(average_precision(s, "p", keys), list(keys))


def sliced_delta(df: DataFrame) -> DataFrame:
    """Per slice how much the model is above the rules, metric by metric: one pivot of ``sliced_metrics``."""
    each = sliced_metrics(df)
    names = [c for c in each.columns if c not in ("slice", "predictor", "n")]
    of = lambda who, c: F.max(F.when(F.col("predictor") == who, F.col(c)))
    return each.groupBy("slice").agg(*[(of("model", c) - of("rules", c)).alias(c) for c in names])


def uncertainty(df: DataFrame, p: str, band: tuple[float, float] = config.UNCERTAIN) -> DataFrame:
    """Share of rows in the uncertain band; error rates inside and outside."""
    inside = (F.col(p) >= band[0]) & (F.col(p) <= band[1])
    wrong = ((F.col(p) >= 0.5).cast("int") != F.col("y")).cast("double")
    return df.agg(F.avg(inside.cast("double")).alias("share"), F.coalesce(F.avg(F.when(inside, wrong)), F.lit(0.0)).alias("inside"), F.coalesce(F.avg(F.when(~inside, wrong)), F.lit(0.0)).alias("outside"))


def agreement(df: DataFrame) -> DataFrame:
    m, r = (F.col("p_model") >= 0.5).cast("int"), (F.col("p_rule") >= 0.5).cast("int")
    same = lambda a, b: F.avg((a == b).cast("double"))
    return df.agg(same(m, F.col("y")).alias("model_truth"), same(r, F.col("y")).alias("rule_truth"), same(m, r).alias("model_rule"))


def decile_edges(df: DataFrame, key: str, value: str, bins: int = config.PSI_BINS) -> DataFrame:
    """``key, edges``: the inner quantiles of each key, equal ones once; the ends are open."""
    return quantiles(df, key, value, [k / bins for k in range(1, bins)]).groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("edges"))


def baseline_bins(df: DataFrame, key: str, value: str, bins: int = config.PSI_BINS) -> DataFrame:
    """``key, bin, edge, share``: every bin's upper edge (null for the last) and share of the key's rows."""
    edges = decile_edges(df, key, value, bins)
    counts = df.join(edges, key).groupBy(key, F.size(F.filter("edges", lambda e: e < F.col(value))).alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select(key, "edges", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, [key, "bin"], "left").select(key, "bin", F.try_element_at("edges", F.col("bin") + 1).alias("edge"), (n / F.sum(n).over(Window.partitionBy(key))).alias("share"))


def psi(values: DataFrame, baseline: Column, key: str, value: str, bins: int = config.PSI_BINS, floor: float = config.PSI_FLOOR) -> DataFrame:
    """Population stability index per key: bins at the baseline's deciles, shares floored and scaled to 1 again.

    The edges are one row per key, joined by key; each value finds its bin by counting the edges below it.
    """
    edges = decile_edges(values.where(baseline), key, value, bins)
    placed = values.join(edges, key).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    counts = placed.groupBy(key, "bin").agg(F.sum(F.when(baseline, 1).otherwise(0)).alias("b"), F.sum(F.when(baseline, 0).otherwise(1)).alias("c"))
    every = edges.select(key, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    w = Window.partitionBy(key)
    shares = every.join(counts, [key, "bin"], "left").select(key, *[F.greatest(F.coalesce(x, F.lit(0)) / F.sum(F.coalesce(x, F.lit(0))).over(w), F.lit(floor)).alias(x) for x in ("b", "c")])
    scaled = shares.select(key, *[(F.col(x) / F.sum(x).over(w)).alias(x) for x in ("b", "c")])
    return scaled.groupBy(key).agg(F.sum((F.col("c") - F.col("b")) * F.log(F.col("c") / F.col("b"))).alias("psi"))


def slot_values(slots: DataFrame, names: tuple[str, ...], key: str = "case_id") -> DataFrame:
    """``feature, v``: the numeric slots of all cases, one row per case and slot, by the slots' names."""
    columns = [c for c in slots.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("v")) for n, c in zip(names, columns, strict=True)])
    return slots.select(F.explode(pairs).alias("x")).select("x.*")


def drift_baseline(values: DataFrame, key: str = "feature", value: str = "v", bins: int = config.PSI_BINS) -> DataFrame:
    """``key, mean, std, lo, hi, constant, edges, shares``: what is stored of a set of values to hold later ones against."""
    stats = values.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    listed = baseline_bins(values, key, value, bins).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "edge", "share"))).alias("b"))
    return stats.join(listed, key).select(key, "mean", "std", "lo", "hi", (F.col("hi") - F.col("lo") < 1e-12).alias("constant"), F.filter(F.transform("b", lambda x: x["edge"]), lambda e: e.isNotNull()).alias("edges"), F.transform("b", lambda x: x["share"]).alias("shares"))


def psi_to(baseline: DataFrame, values: DataFrame, key: str = "feature", value: str = "v", floor: float = config.PSI_FLOOR) -> DataFrame:
    """``key, psi, constant`` of values against a stored baseline: shares of both in the baseline's bins, floored and scaled to 1 again; a feature that is gone counts as nothing in every bin."""
    found = values.join(baseline.select(key, "edges"), key).groupBy(key, F.size(F.filter("edges", lambda e: e < F.col(value))).alias("bin")).agg(F.count("*").alias("c"))
    every = baseline.select(key, "constant", F.posexplode("shares").alias("bin", "b")).join(found, [key, "bin"], "left")
    w = Window.partitionBy(key)
    n = F.coalesce("c", F.lit(0))
    total = F.sum(n).over(w)
    floored = every.select(key, "constant", F.greatest("b", F.lit(floor)).alias("b"), F.greatest(F.when(total > 0, n / total).otherwise(0.0), F.lit(floor)).alias("c"))
    scaled = floored.select(key, "constant", *[(F.col(x) / F.sum(x).over(w)).alias(x) for x in ("b", "c")])
    return scaled.groupBy(key, "constant").agg(F.sum((F.col("c") - F.col("b")) * F.log(F.col("c") / F.col("b"))).alias("psi"))


def drift_report(psi: DataFrame, key: str = "feature", most: int = 15, alarm: float = config.PSI_ALARM) -> DataFrame:
    """``rank, feature, psi, flagged`` of the ``most`` features that moved furthest, with the report's ``n_flagged, worst, mean`` on each row."""
    report = psi.agg(F.count_if(F.col("psi") > alarm).alias("n_flagged"), F.max("psi").alias("worst"), F.avg("psi").alias("mean"))  # one row
    top = psi.orderBy(F.desc("psi"), key).limit(most).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("psi"), key)))
    return top.crossJoin(F.broadcast(report)).select("rank", F.col(key).alias("feature"), "psi", (F.col("psi") > alarm).alias("flagged"), "n_flagged", "worst", "mean")
