"""From hits to dimensions, components, score, level, reason and category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import config
from riskspark.functions.text import clamp, kb_handle, kb_tag, kb_text, risk_level
from riskspark.operators.match import find_matches
from riskspark.session import materialise


def fold(c: Column) -> Column:
    """Saturating sum of confidences as an aggregate: each adds its share of what is left to 100. Order does not matter."""
    return 100 * (1 - F.product(1 - F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)) / 100))


def fold_row(*values: Column) -> Column:
    """The same over a few columns of a row, strongest first."""
    ordered = F.sort_array(F.array(*[F.greatest(v.cast("double"), F.lit(0.0)) for v in values]), asc=False)
    return F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x * (1 - acc / 100))


def dimensions(cases: DataFrame, hits: DataFrame, images: DataFrame, dims: DataFrame) -> DataFrame:
    """``case_id, dim_no, dim, value``: eight rows per case; hits by dimension and image labels (score * 100) folded."""
    parts = hits.where("dim <> 'negative'").select("case_id", "dim", "confidence").unionByName(images.where("dim <> ''").select("case_id", "dim", (F.col("score") * 100).alias("confidence")))
    summed = parts.groupBy("case_id", "dim").agg(F.round(fold(F.col("confidence")), 9).alias("x"))
    return cases.select("case_id").crossJoin(F.broadcast(dims)).join(summed, ["case_id", "dim"], "left").select("case_id", "dim_no", "dim", clamp(F.coalesce("x", F.lit(0.0))).alias("value"))


def strongest(hits: DataFrame, key: str, value: Column) -> DataFrame:
    """Per case and ``key``: ``value`` of the hit with the highest confidence, first in hit order on ties."""
    order = F.struct("confidence", *[(-F.col(c)).alias(c) for c in ("lane", "seg_no", "rule_ord", "pos")], "source", "signal")
    return hits.groupBy("case_id", key).agg(F.max_by(value, order).alias("best"))


def wide(dims: DataFrame) -> DataFrame:
    """One column per dimension."""
    return dims.groupBy("case_id").pivot("dim", list(config.DIMENSIONS)).agg(F.first("value"))


def negatives(hits: DataFrame) -> DataFrame:
    return hits.where("dim = 'negative'").groupBy("case_id").agg(F.round(fold(F.col("confidence")), 9).alias("neg"))


def wide_dimensions(cases: DataFrame, hits: DataFrame, images: DataFrame, kb: DataFrame) -> DataFrame:
    """``wide(raise_reused(dimensions(...), kb))`` with ``negatives``, by one aggregate over what a case has: no case is taken apart into a row per dimension and put together again."""
    nothing = F.lit(None)
    parts = [
        (cases.select("case_id"), nothing, nothing, nothing, F.lit(True)),
        (hits.select("case_id", "dim", "confidence"), F.col("dim"), F.col("confidence"), nothing, nothing),
        (images.where("dim not in ('', 'negative')").select("case_id", "dim", "score"), F.col("dim"), F.col("score") * 100, nothing, nothing),
        (kb.select("case_id", "kb_score"), nothing, nothing, F.col("kb_score"), nothing),
    ]
    rows = reduce(DataFrame.unionByName, [df.select("case_id", dim.cast("string").alias("dim"), value.cast("double").alias("value"), least.cast("int").alias("least"), known.cast("boolean").alias("known")) for df, dim, value, least, known in parts])
    of = lambda d: F.round(fold(F.when(F.col("dim") == d, F.col("value"))), 9)
    summed = rows.groupBy("case_id").agg(*[of(d).alias(d) for d in config.DIMENSIONS], F.when(F.count_if(F.col("dim") == "negative") > 0, of("negative")).alias("neg"), F.max("least").alias("least"), F.max("known").alias("known")).where("known")
    value = lambda d: F.greatest(clamp(F.col(d)), F.coalesce("least", F.lit(0))) if d == "reused" else clamp(F.col(d))
    return summed.select("case_id", *[value(d).alias(d) for d in config.DIMENSIONS], "neg")


def components(d: DataFrame) -> DataFrame:
    """The five components of the wide dimension table."""
    c = F.col
    return d.withColumns({
        "text_speech": fold_row(c("profit"), 0.85 * c("urgency")),
        "visual_part": fold_row(c("gambling"), c("visual")),
        "metadata_links": fold_row(0.85 * c("hashtags"), 0.8 * c("messenger")),
        "behavior": fold_row(c("referral"), 0.7 * c("urgency"), 0.6 * c("messenger")),
        "db_similarity": c("reused").cast("double"),
    })


def overall(d: DataFrame) -> DataFrame:
    """Weighted sum of the components, damped by negative markers; the level comes from the unrounded value."""
    w = config.COMPONENT_WEIGHTS
    parts = {"text_speech": "text_speech", "visual": "visual_part", "metadata_links": "metadata_links", "behavior": "behavior", "db_similarity": "db_similarity"}
    total = reduce(lambda a, b: a + b, [F.lit(w[k]) * F.col(v) for k, v in parts.items()])
    damped = total * (1 - F.least(F.lit(0.55), F.coalesce("neg", F.lit(0.0)) / 180))
    return d.withColumn("overall", damped).withColumn("score", clamp(F.col("overall"))).withColumn("level", risk_level(F.col("overall")))


def main_reason(d: DataFrame, hits: DataFrame) -> DataFrame:
    """``reason``: below medium a fixed text, else the largest dimension (first on ties) and the strongest hit of it."""
    ranked = F.array(*[F.struct(F.col(k).alias("v"), F.lit(-n).alias("n"), F.lit(k).alias("k")) for n, k in enumerate(config.DIMENSIONS)])
    named = d.withColumn("top_dim", F.array_max(ranked)["k"])
    best = strongest(hits, "dim", F.coalesce(F.nullif(F.trim("fragment"), F.lit("")), F.col("signal"))).withColumnRenamed("dim", "top_dim")
    text = F.when(F.col("best").isNotNull(), F.concat(F.col("top_dim"), F.lit(": «"), F.col("best"), F.lit("»"))).otherwise(F.col("top_dim"))
    low = F.when(F.coalesce("neg", F.lit(0.0)) > 0, "warns of fraud").otherwise("no clear signs")
    return named.join(best, ["case_id", "top_dim"], "left").withColumn("reason", F.when(F.col("overall") < config.MEDIUM, low).otherwise(text)).drop("best")


def said(text: Column) -> Column:
    """Per rule of the categories whether the text holds one of its words; true where it asks for none."""
    each = lambda low: F.array(*[reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) if words else F.lit(True) for _, _, _, words, _ in config.CATEGORIES])
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), each), 1)


def category(d: DataFrame, text: Column) -> Column:
    """First rule that holds; educational rules go first when negative markers weigh enough, then all in order."""
    return category_said(d, said(text))


def category_said(d: DataFrame, spoken: Column) -> Column:
    """The same from ``said`` of the case's text."""

    def holds(rule: tuple) -> Column:
        _, dim, least, words, _ = rule
        out = F.lit(True)
        if dim:
            out = out & (F.col(dim) >= least)
        if words:
            out = out & F.element_at(spoken, config.CATEGORIES.index(rule) + 1)
        return out

    significant = F.coalesce("neg", F.lit(0.0)) >= config.NEGATIVE_SIGNIFICANT
    out = None
    for rule in [r for r in config.CATEGORIES if r[4]]:
        out = F.when(significant & holds(rule), rule[0]) if out is None else out.when(significant & holds(rule), rule[0])
    for rule in config.CATEGORIES:
        out = out.when(holds(rule), rule[0])
    return out.when(F.col("score") < config.MEDIUM, "no_violation").otherwise("suspicious_other")


def fingerprint(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``case_id, handles, tags, text``: what is compared with the knowledge base."""
    handles = links.where("kind = 'telegram'").groupBy("case_id").agg(F.collect_set(kb_handle(F.col("value"))).alias("handles"))
    text = F.concat_ws(" ", "title", "description", "tags")
    # Words that begin with a number sign; split into words, every word of a text would be an item of an array.
    marked = F.regexp_extract_all(F.lower(text), F.lit(r"((?<![^ ,\n\t\r])#[^ ,\n\t\r]*+)"), F.lit(1))
    tags = F.array_distinct(F.filter(F.transform(marked, kb_tag), lambda x: x != ""))
    return posts.select("case_id", tags.alias("tags"), kb_text(text).alias("text")).join(handles, "case_id", "left").withColumn("handles", F.coalesce("handles", F.array().cast("array<string>")))


def postings(clusters: DataFrame) -> DataFrame:
    """``kind, token, ord``: each handle, tag and keyword of each cluster once; empty ones are none."""
    kinds = [("h", "handles"), ("t", "tags"), ("k", "keywords")]
    return reduce(DataFrame.unionByName, [clusters.select(F.lit(k).alias("kind"), F.explode(F.array_distinct(c)).alias("token"), "ord") for k, c in kinds]).where("token <> ''")


def case_tokens(prints: DataFrame, posted: DataFrame) -> DataFrame:
    """``case_id, kind, token``: handles and tags of the cases, and the keywords of the clusters that their texts hold (one scan for all keywords)."""
    words = posted.where("kind = 'k'").select("token").distinct()
    rules = words.select(F.xxhash64("token").alias("ord"), F.col("token").alias("pattern"), F.lit(False).alias("is_regex"), F.lit("").alias("label"))
    held = find_matches(prints.select("case_id", "text"), rules, every=False, case=True).select("case_id", F.lit("k").alias("kind"), F.col("pattern").alias("token")).distinct()
    own = [prints.select("case_id", F.lit(k).alias("kind"), F.explode(F.array_distinct(c)).alias("token")) for k, c in (("h", "handles"), ("t", "tags"))]
    return reduce(DataFrame.unionByName, [*own, held]).where("token <> ''")


def sizes(tokens: DataFrame, key: str) -> DataFrame:
    """``key`` and the numbers of its tokens by kind, ``n_h, n_t, n_k``."""
    return tokens.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in "htk"])


def likeness(common: DataFrame, tokens: DataFrame, posted: DataFrame) -> DataFrame:
    """``case_id, ord, raw`` from the numbers of common tokens by kind (``case_id, ord, c_h, c_t, c_k``) and of all tokens of both sides."""
    mine, theirs = sizes(tokens, "case_id").drop("n_k"), sizes(posted, "ord").select("ord", F.col("n_h").alias("m_h"), F.col("n_t").alias("m_t"), "n_k")
    part = lambda c, whole: F.coalesce(F.col(c) / F.nullif(whole, F.lit(0)), F.lit(0.0))
    a, b, c = config.KB_WEIGHTS
    jaccard = lambda k: part(f"c_{k}", F.col(f"n_{k}") + F.col(f"m_{k}") - F.col(f"c_{k}"))
    return common.join(mine, "case_id").join(theirs, "ord").select("case_id", "ord", F.round(a * jaccard("h") + b * jaccard("t") + c * part("c_k", F.col("n_k")), 9).alias("raw"))


def in_common(tokens: DataFrame, posted: DataFrame) -> DataFrame:
    """Numbers of common tokens by kind of every case and cluster that share one."""
    return tokens.join(posted, ["kind", "token"]).groupBy("case_id", "ord").agg(*[F.count_if(F.col("kind") == k).alias(f"c_{k}") for k in "htk"])


def kb_pairs(prints: DataFrame, clusters: DataFrame) -> DataFrame:
    """``case_id, cluster, ord, raw``: likeness of every case to every cluster that it has a handle, a tag or a keyword in common with; to all others it is 0.

    ``clusters``: ord, cluster, handles, tags, keywords (arrays).  Cases meet clusters by equal tokens, so what is joined is a posting per token, not all cases with all clusters.
    """
    posted = materialise(postings(clusters))
    tokens = materialise(case_tokens(prints, posted))
    return likeness(in_common(tokens, posted), tokens, posted).join(clusters.select("ord", "cluster"), "ord").select("case_id", "cluster", "ord", "raw")


def kb_all_pairs(prints: DataFrame, clusters: DataFrame) -> DataFrame:
    """``kb_pairs`` with the likeness 0 of all other pairs: a row for every case and cluster, whatever they share."""
    every = prints.select("case_id").crossJoin(F.broadcast(clusters.select("cluster", "ord")))
    found = kb_pairs(prints, clusters).select("case_id", "ord", "raw")
    return every.join(found, ["case_id", "ord"], "left").select("case_id", "cluster", "ord", F.coalesce("raw", F.lit(0.0)).alias("raw"))


#: A token of more clusters than this is looked up only for cases that it can still decide.
COMMON = 1000


def kb_similarity(prints: DataFrame, clusters: DataFrame, common: int = COMMON) -> DataFrame:
    """``case_id, cluster, raw, kb_score`` of the most similar cluster (first on ties); below the least there is none.

    First only clusters that share a token which at most ``common`` clusters have are compared.  A cluster that shares none but common tokens is at most at
    w_h * (the case's common handles / its handles) + the same of tags + w_k (if it holds a common keyword): where the best one is above that bound it is the best of all,
    and only the other cases meet the clusters of their common tokens as well.
    """
    posted = postings(clusters)
    counted = posted.groupBy("kind", "token").agg(F.count("*").alias("n"))
    posted = materialise(posted.join(counted, ["kind", "token"]).withColumn("often", F.col("n") > common).drop("n"))
    often = counted.where(F.col("n") > common).select("kind", "token", F.lit(True).alias("often"))
    tokens = materialise(case_tokens(prints, posted).join(often, ["kind", "token"], "left").withColumn("often", F.coalesce("often", F.lit(False))))
    plain, all_posted = tokens.select("case_id", "kind", "token"), posted.select("kind", "token", "ord")

    def best(pairs: DataFrame) -> DataFrame:
        # Of the pairs at hand all tokens count, common ones too.
        full = plain.join(pairs, "case_id").join(all_posted, ["kind", "token", "ord"]).groupBy("case_id", "ord").agg(*[F.count_if(F.col("kind") == k).alias(f"c_{k}") for k in "htk"])
        return likeness(full, plain, all_posted).groupBy("case_id").agg(F.max(F.struct("raw", (-F.col("ord")).alias("first"))).alias("b"))

    def pairs(of: DataFrame, to: DataFrame) -> DataFrame:
        return of.select("case_id", "kind", "token").join(to.select("kind", "token", "ord"), ["kind", "token"]).select("case_id", "ord").distinct()

    found = materialise(best(pairs(tokens.where("not often"), posted.where("not often"))))
    if posted.where("often").limit(1).count():
        a, b, c = config.KB_WEIGHTS
        share = lambda k: F.coalesce(F.count_if((F.col("kind") == k) & F.col("often")) / F.nullif(F.count_if(F.col("kind") == k), F.lit(0)), F.lit(0.0))
        bounds = tokens.groupBy("case_id").agg((a * share("h") + b * share("t") + F.when(F.count_if((F.col("kind") == "k") & F.col("often")) > 0, c).otherwise(0.0)).alias("bound")).where("bound > 0")
        # Bounds and likenesses are rounded alike, so a tie stays open.
        open_ones = bounds.join(found, "case_id", "left").where(F.col("b").isNull() | (F.round("bound", 9) >= F.col("b.raw"))).select("case_id")
        more = best(pairs(tokens.where("often").join(open_ones, "case_id", "left_semi"), posted.where("often")))
        found = found.unionByName(more).groupBy("case_id").agg(F.max("b").alias("b"))
    named = found.select("case_id", F.col("b.raw").alias("raw"), (-F.col("b.first")).alias("ord")).join(clusters.select("ord", "cluster"), "ord")
    every = prints.select("case_id").join(named, "case_id", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    near = F.col("raw") >= config.KB_LEAST
    return every.select("case_id", F.when(near, F.col("cluster")).otherwise("isolated").alias("cluster"), "raw", F.when(near, clamp(F.col("raw") * config.KB_SCALE)).otherwise(0).alias("kb_score"))


def raise_reused(dims: DataFrame, kb: DataFrame) -> DataFrame:
    """Dimension ``reused`` at least at the knowledge base's score."""
    return dims.join(kb.select("case_id", "kb_score"), "case_id", "left").withColumn("value", F.when(F.col("dim") == "reused", F.greatest("value", F.coalesce("kb_score", F.lit(0)))).otherwise(F.col("value"))).drop("kb_score")


def blend(rule: Column, model: Column, mode: str = "blend", alpha: float = config.BLEND_ALPHA) -> Column:
    """Model and rule score together; without a prediction the rules decide."""
    if mode == "rules":
        return rule
    mixed = model if mode == "model" else alpha * model + (1 - alpha) * rule
    return F.when(model.isNull(), rule).otherwise(clamp(mixed))


def best_k(df: DataFrame, k: int, order: list) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")
