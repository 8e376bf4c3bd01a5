"""Hand-worked cases of the scoring operators."""

import itertools
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark import config, session
from riskspark.functions import text as T
from riskspark.operators import features as X
from riskspark.operators import graph as G
from riskspark.operators import learning as K
from riskspark.operators import match as M
from riskspark.operators import metrics as E
from riskspark.operators import network as N
from riskspark.operators import score as S
from riskspark.operators import timeline as L
from riskspark.plans import registry
from riskspark.plans.base import Inputs
from riskspark.plans.scoring import Scored
from riskspark.sources import cases as C
from riskspark.sources import intake as I


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("xs", "want"), [((90, 80, 70), 99.4), ((100, 55), 100.0), ((-5,), 0.0)])
def test_fold(spark, xs, want):
    for order in itertools.permutations(xs):
        df = spark.createDataFrame([(float(x),) for x in order], "x double")
        assert df.agg(S.fold(F.col("x"))).first()[0] == pytest.approx(want)
        assert one(spark, S.fold_row(*[F.lit(float(x)) for x in order])) == pytest.approx(want)


@pytest.mark.parametrize(("x", "want"), [(0.5, 0), (2.5, 2), (101, 100), (-3, 0)])
def test_clamp(spark, x, want):
    assert one(spark, T.clamp(F.lit(float(x)))) == want


@pytest.mark.parametrize(("x", "want"), [(87.6, "high"), (88, "critical"), (65, "high"), (40, "medium"), (39.9, "low")])
def test_level(spark, x, want):
    assert one(spark, T.risk_level(F.lit(float(x)))) == want


def test_damping_and_rounding(spark):
    dims = dict.fromkeys(("urgency", "gambling", "referral", "messenger", "visual", "reused", "hashtags"), 0)
    row = spark.createDataFrame([(1, 90, None, *dims.values())], "case_id int, profit int, neg double, " + ", ".join(f"{d} int" for d in dims))
    got = S.overall(S.components(row)).first()
    assert (got["score"], got["level"]) == (31, "low")  # 90 * 0.35 is just below 31.5


def test_clock_tag_quote(spark):
    assert one(spark, T.clock(F.lit(75.4))) == "01:15"
    assert one(spark, T.short_clock(F.lit(75.4))) == "1:15"
    assert one(spark, T.kb_tag(F.lit("#Без_вложений"))) == "#безвложений"
    assert one(spark, T.quote(F.lit("  a \n b "))) == "«a b»"
    assert one(spark, T.quote(F.lit(None).cast("string"))) == ""


def test_hashtags(spark):
    assert one(spark, I.split_hashtags(F.lit("a, #B ,b,, #c"))) == ["#a", "#B", "#c"]
    assert one(spark, I.coerce_hashtags(F.lit(None).cast("string"))) == []


def test_metrics(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert E.auroc(tied, "p").first()[0] == 0.5
    one_class = spark.createDataFrame([(1, 0.5)], "y int, p double")
    assert E.auroc(one_class, "p").first()[0] == 0.5
    bins = {r["bin"]: r["n"] for r in E.reliability(spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 0.1)], "y int, p double"), "p").collect()}
    assert (bins[0], bins[1], bins[14], len(bins)) == (1, 1, 1, 15)
    quantile = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0)], "y int, p double")
    assert E.threshold_at_fpr(quantile, "p").first()[0] == pytest.approx(3.6)
    same = spark.createDataFrame([("k", float(x), b) for x in range(50) for b in (True, False)], "k string, v double, base boolean")
    assert E.psi(same, F.col("base"), "k", "v").first()["psi"] == pytest.approx(0)


def test_timeline_dedup_is_greedy(spark):
    rows = [(1, 0.0, "A", "x", 50.0), (1, 0.9, "A", "y", 90.0), (1, 1.8, "A", "z", 10.0), (1, 9.0, "A", "Y", 20.0), (1, 9.0, "B", "y", 20.0)]
    events = spark.createDataFrame(rows, "case_id int, time_s double, source string, signal string, confidence double")
    got = sorted((r["source"], r["signal"], r["time_s"]) for r in L.dedup(events).collect())
    assert got == [("A", "y", 0.9), ("B", "y", 9.0)]
    again = L.dedup(L.dedup(events))
    assert sorted((r["source"], r["signal"], r["time_s"]) for r in again.collect()) == got


def plain_fold(events):
    """The same events one by one, every kept one looked at."""
    rank = lambda c: (sum(c >= x for x in (45, 65, 85)), c)
    kept = []
    for e in sorted(events):
        at = next((i for i, k in enumerate(kept) if k[1] == e[1] and (abs(k[0] - e[0]) <= config.TIMELINE_WINDOW or k[2].lower() == e[2].lower())), None)
        if at is None:
            kept.append(e)
        elif rank(e[3]) > rank(kept[at][3]):
            kept[at] = e
    return kept


def test_timeline_fold_is_the_plain_one(spark):
    """Random cases: anchors that move, signals that change, ties, several sources; cases that partitions' batches cut."""
    rng, rows = np.random.default_rng(7), []
    for case in range(60):
        for _ in range(int(rng.integers(1, 120))):
            rows.append((case if case else None, float(rng.integers(0, 40)) / 4, "AB"[rng.integers(2)], str(rng.choice(["x", "X", "y", "z", "ÄB", "äb", *map(str, range(9))])), float(rng.integers(0, 100))))
    df = spark.createDataFrame([*rows, (1, None, "A", "x", 5.0)], "case_id long, time_s double, source string, signal string, confidence double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = sorted((r["case_id"] or 0, r["time_s"], r["source"], r["signal"], r["confidence"]) for r in L.dedup(df).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for case in range(60):
        want += [(case, *e) for e in plain_fold([r[1:] for r in rows if (r[0] or 0) == case])]
    assert got == sorted(want)


def test_timeline_fold_holds_kept_events_only():
    """A million events of one case and source with 50 signals: at most 50 are held."""
    fold = L.Fold(1.0)
    for k in range(1_000_000):
        fold.add(k * 0.7, f"s{k * 7919 % 50}", float(k * 31 % 97))
    assert len(fold.kept) <= 50 and len(fold.near) < 5000


def test_cases(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, title string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, title string, seq int")
    assert sorted((r["id"], r["title"]) for r in C.upsert_cases(old, new).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert C.list_cases(old.withColumn("created", F.lit("")), 0).count() == 0
    packed = C.pack_cases(old).withColumn("payload", F.when(F.col("id") == 1, "oops").otherwise(F.col("payload")))
    assert [r["id"] for r in C.unpack_cases(packed, "id INT, title STRING, seq INT").collect()] == [2]


def test_text_folding(spark):
    assert one(spark, T.nfkc_casefold(F.lit("ＡßC"))) == "assc"
    assert one(spark, T.looks_obfuscated(F.lit("к а з и н о")))
    assert one(spark, T.looks_obfuscated(F.lit("д0ход")))
    assert not one(spark, T.looks_obfuscated(F.lit("a quiet day")))
    assert [one(spark, T.language_hint(F.lit(x))) for x in ("", "привет", "hello", "сәлем")] == ["", "ru", "en", "kz"]


TEXT = "case_id long, source_ord int, source_field string, place long, time_s double, text string"


def test_hits_of_all_texts(spark):
    """Calls and markers that are only spoken or shown count; each matched text, and each contact, is a hit of its own."""
    rows = [(1, 0, "description", 0, None, "Зови 5 человек, зови 3. ЗОВИ 5"), (1, 1, "transcript", M.PLACE + 2, 10.0, "тут"), (1, 1, "transcript", M.PLACE + 3, 15.0, "Тапай сюда"), (1, 2, "ocr", 2 * M.PLACE + 7, 3.0, "тапай сюда text me, это обман")]
    texts = spark.createDataFrame(rows, TEXT)
    lexicon = spark.createDataFrame([(0, "referral", "человек", 50, False, "")], "ord int, dim string, pattern string, weight int, is_regex boolean, label string")
    negatives = spark.createDataFrame([(0, "обман", 40)], "ord int, pattern string, weight int")
    found = M.find_matches(texts, M.all_rules(lexicon, negatives, M.call_rules(spark)), every=False)
    got = M.call_hits(found, texts.where("source_ord > 0").select("case_id", "time_s", "text")).collect()
    assert sorted((r["chip"], r["seg_no"], r["pos"], r["time_s"], r["fragment"]) for r in got) == [("text me", 2 * M.PLACE + 7, 12, 3.0, "text me"), ("зови N", 0, 1, None, "Зови 5"), ("зови N", 0, 17, None, "зови 3"), ("тапай сюда", M.PLACE + 3, 1, 3.0, "Тапай сюда")]
    assert [(r["chip"], r["dim"], r["time_s"]) for r in M.scan_negatives(found).collect()] == [("обман", "negative", None)]
    assert [(r["chip"], r["source"], r["pos"]) for r in M.scan(found).collect()] == [("человек", "Metadata", 8)]
    links = M.extract_links(spark.createDataFrame([(1, 0, "description", 0, None, "t.me/first_one и t.me/second_one"), (1, 1, "transcript", M.PLACE, 0.0, "код ABC123, cutt.ly/x1 и T.ME/First_One")], TEXT))
    assert sorted((r["kind"], r["value"]) for r in links.collect()) == [("promocode", "ABC123"), ("telegram", "first_one"), ("telegram", "second_one"), ("url", "cutt.ly/x1")]
    kinds = spark.createDataFrame([("telegram", "messenger", 70, "Канал")], "kind string, dim string, confidence int, signal string")
    assert sorted(r["signal"] for r in M.funnel_hits(links, kinds).collect()) == ["Канал: first_one", "Канал: second_one"]


RULE = "ord int, pattern string, is_regex boolean, label string"


def test_rules_in_one_automaton_or_several(spark, monkeypatch):
    """Rules beyond one automaton give the same matches from several; no rules, no matches."""
    texts = spark.createDataFrame([(1, "Зови 5. ЗОВИ 12 друзей (a.b) 😀 a.b"), (2, ""), (3, None)], "case_id int, text string")
    rules = spark.createDataFrame([(0, "a.b", False, ""), (1, "зови [0-9]+", True, ""), (2, "друзей", False, "d"), (3, "", False, ""), (4, "x*", True, "")], RULE)
    found = lambda **how: sorted((r["ord"], r["pos"], r["matched"], r["chip"]) for r in M.find_matches(texts, rules, **how).collect())
    want = [(0, 25, "a.b", "a.b"), (0, 32, "a.b", "a.b"), (1, 1, "Зови 5", "зови 5"), (1, 9, "ЗОВИ 12", "зови 12"), (2, 17, "друзей", "d")]
    assert found() == want
    assert found(every=False) == [x for x in want if x[:2] != (0, 32)]
    assert M.find_matches(texts, rules.limit(0)).count() == 0
    monkeypatch.setattr(M, "RULES_AT_ONCE", 2)
    assert found() == want


def test_hits_do_not_depend_on_the_number_of_rules(spark):
    """Five rules, and the same five among five thousand: the same hits, those that a case-insensitive regular expression finds (final sigma, dotted capital I, long s, Kelvin sign)."""
    texts = ["ΟΔΟΣ и οδος, οδοσ", "İstanbul ISTANBUL ıstanbul", "ſale SALE sale", "300 \u212a 300 k", "nothing", "ΟΔΟΣΟΔΟΣΟΔΟΣ straße STRASSE"]
    few = [(0, "οδος", False), (1, "istanbul", False), (2, "sale", False), (3, "300 k", False), (4, "stra(ße|sse)", True)]
    many = few + [(k, f"word{k} or {k * 7}", False) for k in range(5, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "case_id int, text string")
    of = lambda rules: sorted((r["case_id"], r["ord"], r["pos"], r["matched"]) for r in M.find_matches(df, spark.createDataFrame([(*x, "") for x in rules], RULE)).collect())
    want = sorted((k, n, m.start() + 1, m[0]) for k, t in enumerate(texts) for n, p, is_regex in few for m in re.finditer(p if is_regex else re.escape(p), t, re.IGNORECASE))
    assert len(want) == 16 and of(few) == want == of(many)


def test_folding_is_the_case_rule_of_regular_expressions():
    """Over all characters: alike when folded, as far as a case-insensitive match takes one for the other."""
    alike = {}
    for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x20000))):
        alike.setdefault(M.fold(c), []).append(c)
        assert len(M.fold(c)) == 1
    groups = [g for g in alike.values() if len(g) > 1]
    assert len(groups) > 1000
    for g in groups:
        assert all(re.fullmatch(re.escape(a), b, re.IGNORECASE) for a, b in itertools.combinations(g, 2))
    # No character of another group meets one of a group.
    every = "".join(g[0] for g in alike.values())
    for g in groups:
        assert re.findall(re.escape(g[0]), every, re.IGNORECASE) == [g[0]]


@pytest.mark.parametrize(("regex", "want"), [("[0-9 ]+ тенге за вечер", " тенге за вечер"), ("зови [0-9]+", "зови "), ("a|b", ""), ("(ab)?c", ""), ("abc?d", "ab"), ("ab{2,3}cd", "cd"), ("a\\.bc\\s+d", "a.bc"), ("\\d+", ""), ("[]x]ab", "ab")])
def test_needed_text(regex, want):
    assert M.needed(regex) == want


def kb_plain(cases, clusters):
    """Every case against every cluster."""
    near = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0
    return {(c, n): round(0.45 * near(h, kh) + 0.3 * near(g, kg) + 0.25 * (sum(w in text for w in set(kw)) / len(set(kw)) if kw else 0), 9) for c, h, g, text in cases for n, _, kh, kg, kw in clusters}


@pytest.mark.parametrize("common", [2, 1000])
def test_knowledge_base_by_postings(spark, common):
    """The best of 300 clusters is that of comparing all, also where tokens are common to many of them; no case meets a cluster by a nested loop."""
    rng = np.random.default_rng(12)
    some = lambda k, n, m: [f"{k}{x}" for x in sorted({int(x) for x in np.minimum(rng.geometric(0.12, n), m)})]
    clusters = [(n, f"c{n}", some("h", rng.integers(0, 4), 40), some("#t", rng.integers(0, 4), 40), some("word", rng.integers(0, 4), 40)) for n in range(300)]
    cases = [(c, some("h", rng.integers(0, 4), 45), some("#t", rng.integers(0, 4), 45), " ".join(some("word", rng.integers(0, 5), 45))) for c in range(80)]
    prints = spark.createDataFrame(cases, "case_id long, handles array<string>, tags array<string>, text string")
    kb = spark.createDataFrame(clusters, "ord int, cluster string, handles array<string>, tags array<string>, keywords array<string>")
    want = kb_plain(cases, clusters)
    got = {(r["case_id"], r["ord"]): r["raw"] for r in S.kb_pairs(prints, kb).collect()}
    assert got == {k: v for k, v in want.items() if v > 0}
    found = S.kb_similarity(prints, kb, common)
    for r in found.collect():
        best = max((want[r["case_id"], n], -n) for n in range(300))
        assert r["raw"] == best[0] and r["cluster"] == (f"c{-best[1]}" if best[0] >= config.KB_LEAST else "isolated")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_likeness_of_every_case_and_cluster(spark):
    """Pairs that have nothing in common are there too, with 0."""
    clusters = [(0, "a", ["x"], ["#t"], ["word"]), (1, "b", ["y"], [], []), (2, "c", [], [], [])]
    cases = [(1, ["x"], [], "a word"), (2, [], [], "")]
    prints = spark.createDataFrame(cases, "case_id long, handles array<string>, tags array<string>, text string")
    kb = spark.createDataFrame(clusters, "ord int, cluster string, handles array<string>, tags array<string>, keywords array<string>")
    assert {(r["case_id"], r["ord"]): r["raw"] for r in S.kb_all_pairs(prints, kb).collect()} == kb_plain(cases, clusters)
    assert "WHERE raw > 0" not in registry.oracle_sql()["ag11_kb_similarity"]


def test_labels_in_several_passes(spark, monkeypatch):
    """Any number of prompts: partial sums of several passes give the softmax over all."""
    rng = np.random.default_rng(2)
    prompts = [(f"p{k:02}", "d" if k % 3 else "", rng.normal(size=6).tolist()) for k in range(30)]
    frames = [(k // 2, k, (rng.normal(size=6) * 3).tolist() if k != 5 else [0.0] * 6) for k in range(40)] + [(20, 40, None)]
    df = spark.createDataFrame(frames, "case_id long, frame long, embedding array<double>")
    found = lambda: sorted((r["frame"], r["label"], round(r["p"], 9)) for r in M.image_labels(df, spark.createDataFrame(prompts, "label string, dim string, vector array<double>"), least=0.05).collect())
    unit = np.array([p[2] / np.linalg.norm(p[2]) for p in prompts])
    want = []
    for _, f, e in frames:
        if e and any(e):
            z = 100 * unit @ (np.array(e) / np.linalg.norm(e))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            want += [(f, prompts[j][0], round(float(p[j]), 9)) for j in range(30) if p[j] > 0.05 and prompts[j][1]]
    assert found() == sorted(want)
    monkeypatch.setattr(M, "PROMPTS_AT_ONCE", 4)
    assert found() == sorted(want)


def test_fixed_formats(spark):
    """Hand-worked rows of hosts, tags, look-alikes and categories."""
    places = [("https://vk.com/a", "VK"), ("m.vkvideo.ru/x", "VK"), ("https://facebook.com/x", "Instagram"), ("https://t.me/x", "Telegram"), (None, "Instagram")]
    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(places)], "k int, u string").select("k", I.resolve_platform(F.lit(None).cast("string"), F.col("u")).alias("p"))
    assert [r["p"] for r in got.orderBy("k").collect()] == [p for _, p in places]
    assert one(spark, F.array_join(I.resolve_hashtags(F.lit(None).cast("string"), F.lit("(#win) «#tag» #win, #, x#y \"#q\"")), "|")) == "#win|#tag|#q"
    assert one(spark, T.fold_lookalikes(F.lit("KA3NHO 1@$5"))) == "каепно иаѕѕ"
    neg = spark.createDataFrame([(t, 50.0, 0.0, 0.0, 0.0, 10) for t in ("Разоблачаем схему", "образовательный ролик", "как не попасться", "объясняю простыми словами", "иное")], "text string, neg double, gambling double, referral double, profit double, score int")
    assert [r["c"] for r in neg.select(S.category(neg, F.col("text")).alias("c")).collect()] == ["educational_antifraud", "educational", "educational_antifraud", "educational", "no_violation"]


def test_top_ngrams(spark):
    """By a plain walk over all grams of a case."""

    def plain(words, skeleton, k):
        counts = {}
        for g, n in [*((w, 1) for w in words), *((f"{a} {b}", 2) for a, b in zip(words, words[1:]))]:
            counts[g] = counts.get(g, 0) + n
        for w in skeleton.split():
            padded = f" {w} "
            for n in (3, 4, 5):
                for at in range(len(padded) - n + 1):
                    g = padded[at : at + n].strip()
                    counts[g] = counts.get(g, 0) + 1
        return sorted(counts.items(), key=lambda g: -g[1])[:k]

    rng = random.Random(6)
    cases = [(["abcd", "xy", "abcd", "xy"], "abcdxyabcdxy"), ([], ""), (["a"], "a"), (["12", "#x"], "x"), (["ёж"], "ёж І")]
    cases += [([rng.choice(["ab", "ба", "abab", "c", "12"]) for _ in range(rng.randint(0, 30))], " ".join(rng.choice(["a", "abab", "баба", "cab" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 8)))) for _ in range(60)]
    rows = spark.createDataFrame([(k, w, s) for k, (w, s) in enumerate(cases)] + [(1000, None, None)], "case_id long, w array<string>, s string")
    for k in (1, 4, 50):
        got = {}
        for r in X.top_ngrams(rows, k).collect():
            got.setdefault(r["case_id"], []).append((r["gram"], r["n"]))
        assert got == {case: want for case, (w, s) in enumerate(cases) if (want := plain(w, s, k))}


def test_ngrams_of_texts(spark):
    """Words and skeletons taken in the pass that counts are those of the column functions."""
    rng = random.Random(8)
    signs = [*"aeoABCXyz019#@$.-_*/|\\ \t\n,;!?", *"абвёЁІіҚқӘСЕ", *"\x00\x1c\x85\xa0\u200b\u2060\u2028\u3000·•ßİſΣςﬁＡ①½Å🔥e\u0301"]
    texts = ["", None, "a", " - ", "c a s i n o", "K\u212a ſt", "к.а-з и н о, 7 топ"] + ["".join(rng.choices(signs, k=rng.randint(1, 120))) for _ in range(400)] + [" ".join(rng.choices(["деньги", "Cash", "с-т-а-в", "b3t", "да"], k=300)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "case_id long, text string").repartition(4)
    want = X.top_ngrams(rows.select("case_id", T.folded_words(F.col("text")).alias("w"), T.skeleton(F.col("text")).alias("s")), 6).collect()
    got = X.text_ngrams(rows, 6).collect()
    assert len(got) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    codes = np.append(np.insert(np.random.default_rng(2).integers(1, 60, 20_000), np.arange(6, 20_000, 6), 0), 0)
    codes = np.append(0, codes)
    by_order, X.PLACE_BITS = X._inner(codes), 1
    try:
        assert all((a == b).all() for a, b in zip(by_order, X._inner(codes)))  # places too large for one number
    finally:
        X.PLACE_BITS = 28


def test_matches_are_handed_on_in_pieces():
    """A worker holds one text and a bounded number of hits, however large the batch is and however many hits one text has."""
    class Shared:
        value = [(0, "ab", False, True), (1, "b+", True, True)]

    texts = ["ab " * 9000, None, "", "xab", "ab " * 5000]
    batch = pa.RecordBatch.from_pydict({"case_id": pa.array(range(5), pa.int64()), "text": pa.array(texts, pa.string())})
    pieces = list(M._scan([batch], "pieces", Shared, False, True))
    assert len(pieces) > 5 and max(p.num_rows for p in pieces) <= M.FOUND_AT_ONCE
    got = Counter((r["case_id"], r["__ord"]) for p in pieces for r in p.to_pylist())
    assert got == {(0, 0): 9000, (0, 1): 9000, (3, 0): 1, (3, 1): 1, (4, 0): 5000, (4, 1): 5000}


def test_every_occurrence(spark):
    texts = spark.createDataFrame([(1, "a.b A.B axb 12 3")], "case_id int, text string")
    rules = spark.createDataFrame([(0, "a.b", False, ""), (1, "[0-9]+", True, "")], "ord int, pattern string, is_regex boolean, label string")
    assert sorted((r["ord"], r["pos"], r["matched"]) for r in M.find_matches(texts, rules).collect()) == [(0, 1, "a.b"), (0, 5, "A.B"), (1, 13, "12"), (1, 16, "3")]


def test_no_id_subset(spark, tmp_path):
    """Every post has a clock, also beyond 99 minutes; prompts come from all embeddings."""
    spark.createDataFrame([(k, "text") for k in (1, 100, 1999, 2600, 90_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["case_id"]: (r["long_form"], r["short_form"]) for r in registry.queries()["tx9_clock"](spark, str(tmp_path)).collect()}
    assert got == {1: ("00:00", "0:00"), 100: ("00:00", "0:00"), 1999: ("79:08", "79:08"), 2600: ("104:10", "104:10"), 90_000: ("3745:50", "3745:50")}
    # Label 1 occurs among large ids only.
    spark.createDataFrame([(k, [1.0, 0.0] if k < 5 else [0.0, 1.0], int(k >= 5)) for k in (1, 2, 700, 701)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    names = [label for label, _ in config.PROMPTS]
    seen = {r["frame"]: r["label"] for r in registry.queries()["mx19_image_labels"](spark, str(tmp_path)).collect()}
    shown = {k for k in (0, 1) if config.PROMPTS[k][1]}
    assert seen == {f: names[k] for f, k in ((1, 0), (2, 0), (700, 1), (701, 1)) if k in shown}
    assert 1 in shown or 0 in shown


def test_timeline_of_deduplicated_events(spark):
    """The registered timeline against a plain fold of the same candidates."""
    sf = "/root/testdata/sf0.001"
    t = Inputs(spark, sf)
    cases, rank = {}, lambda c: sum(c >= x for x in (45, 65, 85))
    for e in L.candidates(Scored(t).hits, t.visual).collect():
        cases.setdefault(e["case_id"], []).append((e["time_s"], e["source"], e["signal"], float(e["confidence"])))
    want, raw = [], 0
    for case, events in cases.items():
        kept = []
        for e in sorted(events):
            at = next((i for i, k in enumerate(kept) if k[1] == e[1] and (abs(k[0] - e[0]) <= config.TIMELINE_WINDOW or k[2].lower() == e[2].lower())), None)
            if at is None:
                kept.append(e)
            elif (rank(e[3]), e[3]) > (rank(kept[at][3]), kept[at][3]):
                kept[at] = e
        raw += min(8, len(events))
        best = sorted(sorted(kept, key=lambda e: (-rank(e[3]), -e[3], *e[:3]))[:8], key=lambda e: e[:3])
        want += [(case, f"t{n}", e[1], e[2]) for n, e in enumerate(best, 1)]
    got = registry.queries()["wn3_timeline"](spark, sf).collect()
    assert sorted((r["case_id"], r["id"], r["source"], r["signal"]) for r in got) == sorted(want)
    assert len(want) < raw


def test_split_members(spark):
    """Every stratum gives its share, one row at least, and the same rows however the table lies."""
    df = spark.createDataFrame([(k, "abc"[min(2, k // 300)] if k else None) for k in range(607)], "id long, s string")
    got = {r["id"]: r["held"] for r in K.stratified_split(df, "id", "s", cells=16).collect()}
    again = {r["id"]: r["held"] for r in K.stratified_split(df.repartition(5), "id", "s", cells=16).collect()}
    assert got == again and len(got) == 607
    for low, high, want in ((0, 1, 1), (1, 300, 44), (300, 600, 45), (600, 607, 1)):
        assert sum(got[k] for k in range(low, high)) == want


def test_heads_learn(spark):
    """Risk, dimensions and categories are learned from planted features; the best epoch wins; a missing prediction leaves the rules."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        bad = k % 2
        idx = [int(rng.integers(0, 20)), 20 + bad, 30 + k % 3]
        rows.append((k, idx, [1.0, 1.0, 1.0], [float(bad)] + [bad * 0.8] + [0.1] * 7 + [float(c == k % 3) for c in range(7)], 1.0, k % 7 == 0))
    df = spark.createDataFrame(rows, "case_id long, idx array<int>, val array<double>, y array<double>, w double, held boolean")
    model = K.train_heads(df, 40, parts=3)
    assert model.history[model.best_epoch][1] == min(x for _, x in model.history) < model.history[0][1] / 2
    got = {r["case_id"]: r for r in K.predict(df, model, 40).collect()}
    held = [k for k in range(600) if k % 7 == 0]
    assert all((got[k]["prob"] >= 0.5) == (k % 2 == 1) for k in held)
    assert all(got[k]["category"] == K.CATEGORY_NAMES[k % 3] for k in held)
    assert abs(got[7]["profit"] - 80) < 15 and got[14]["profit"] < 20
    scores = spark.createDataFrame([(1, 10, *[10] * 8), (7000, 40, *[5] * 8)], "case_id long, score int, " + ", ".join(f"{d} int" for d in config.DIMENSIONS))
    mixed = {r["case_id"]: r for r in K.with_fallback(scores, K.predict(df, model, 40)).collect()}
    assert (mixed[7000]["score"], mixed[7000]["urgency"], mixed[7000]["rules_only"]) == (40, 5, True)
    assert mixed[1]["score"] == round(0.6 * got[1]["score"] + 4) and not mixed[1]["rules_only"]


@pytest.mark.parametrize("size", [0, 1, 80, 3000])
def test_isotonic(spark, size):
    """Against pooling of adjacent violators, written plainly; ranges and levels of the tree do not show."""
    rng = np.random.default_rng(9)
    data = [(k, float(np.round(rng.random() ** 4, 3)) if size > 100 else float(rng.integers(0, 12)) / 12, int(rng.random() < 0.5)) for k in range(size)]
    blocks = []
    for p in sorted({x[1] for x in data}):
        ys = [y for _, q, y in data if q == p]
        blocks.append([sum(ys), len(ys), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + ps]
    want = {p: y / n for y, n, ps in blocks for p in ps}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # all ranges stay apart
    got = K.isotonic(spark.createDataFrame([*data, (-1, None, 1)], "id long, p double, y int"), "p").collect()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == size + 1 and all(r["calibrated"] is None if r["p"] is None else abs(r["calibrated"] - want[r["p"]]) < 1e-9 for r in got)


def test_temperature(spark):
    """Within 1e-6 of a plain golden section; 1.0 for no row or one class."""
    rng = np.random.default_rng(5)
    z = rng.normal(0, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 2.2))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    loss = lambda t: -np.mean(np.log(np.where(y == 1, 1 / (1 + np.exp(-z / t)), 1 - 1 / (1 + np.exp(-z / t)))))
    a, b, g = 0.25, 10.0, (5**0.5 - 1) / 2
    while b - a > 1e-9:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    got = K.fit_temperature(df, "p").first()
    assert abs(got["temperature"] - (a + b) / 2) < 1e-6 and abs(got["nll"] - loss(a)) < 1e-9
    assert K.fit_temperature(df.where("y = 1"), "p").first()["temperature"] == 1.0
    assert K.fit_temperature(df.limit(0), "p").first()[:] == (1.0, None)


def test_ranges_are_balanced(spark):
    """A log-normal column, and scores crowded near 0: no range with many more values than the others; metrics stay exact."""
    rng = np.random.default_rng(8)
    values = np.exp(rng.normal(0, 4, 30_000))
    df = spark.createDataFrame([(0, float(v)) for v in values], "k int, v double")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sizes = [r["count"] for r in E.ranged(df, "k", "v").groupBy("__cell").count().collect()]
    got = {r["q"]: r["v"] for r in E.quantiles(df, "k", "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(sizes) > 50 and max(sizes) < 2 * 30_000 / 64
    assert all(got[q] == pytest.approx(np.quantile(values, q), rel=1e-12) for q in got) and len(got) == 5
    y, p = rng.integers(0, 2, 3000), np.round(rng.random(3000) ** 9, 4)
    order = np.argsort(p)
    ranks = np.array([np.mean(np.flatnonzero(p[order] == x)) + 1 for x in p])
    want = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    scored = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    assert E.auroc(scored, "p").first()["auroc"] == pytest.approx(want, abs=1e-12)


def test_network_gradient():
    """Backpropagation against finite differences, with units left out, for weights of both layers and biases."""
    rng = np.random.default_rng(6)
    model = N.Network.drawn(12, 7, seed=3)
    model.first, model.second = model.first.astype(float), rng.normal(0, 0.5, model.second.shape)
    x = np.hstack([rng.normal(size=(9, 12)), np.ones((9, 1))])
    y = rng.random((9, len(K.HEADS)))
    y[:, K.CATS] /= y[:, K.CATS].sum(1, keepdims=True)
    w, kept = rng.random(9), N.kept_units(np.arange(9), 5, 7, 0.3).astype(float)
    grad, _ = model.backward(x, y, w, kept)
    flat = np.concatenate([model.first.ravel(), model.second.ravel()])

    def loss(v):
        n = model.first.size
        return N.Network(v[:n].reshape(model.first.shape), v[n:].reshape(model.second.shape)).backward(x, y, w, kept)[1]

    for at in [*rng.choice(len(flat), 60, replace=False), len(flat) - 1, model.first.size - 1, model.first.size + 1]:
        step = np.zeros_like(flat)
        step[at] = 1e-5
        assert grad[at] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=1e-5)


def test_units_are_drawn_by_row_and_step():
    a, b = N.kept_units(np.arange(4000), 1, 16, 0.1), N.kept_units(np.arange(4000)[::-1].copy(), 1, 16, 0.1)
    assert (a == b[::-1]).all() and not (a == N.kept_units(np.arange(4000), 2, 16, 0.1)).all()
    assert abs((a == 0).mean() - 0.1) < 0.01 and abs(a.mean() - 1) < 0.02


def test_gradients_in_a_tree(spark, monkeypatch):
    """Groups of any size give the sum of all partitions."""
    rng = np.random.default_rng(1)
    data = rng.integers(-50, 50, (11, 3, 4)).astype(np.float32)
    rows = [(c, p, 1.5, 2.0, data[p, c].tobytes()) for p in range(11) for c in range(3)]
    df = spark.createDataFrame(rows, N.GRADIENT).repartition(5)
    for fan in (2, 3, 32):
        monkeypatch.setattr(N, "FAN", fan)
        grad, weight, loss = N.summed(df, 11)
        assert (grad == data.sum(0).ravel()).all() and (weight, loss) == (16.5, 22.0)


def planted(n=900):
    """Risk where exactly one of two marks is there: nothing for linear heads."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        a, b = rng.random(2) < 0.5
        bad = float(a != b)
        idx = [int(rng.integers(0, 10)), *([10] if a else []), *([11] if b else [])]
        rows.append((k, idx, [1.0] * len(idx), [bad] + [0.8 * bad] + [0.1] * 7 + [float(c == k % 3) for c in range(7)], 1.0, k % 6 == 0))
    return rows


ROWS = "case_id long, idx array<int>, val array<double>, y array<double>, w double, held boolean"


def test_network_learns_what_linear_heads_cannot(spark):
    df = spark.createDataFrame(planted(), ROWS).repartition(3)
    net = N.train(df, 12, batch=150, hidden=32, epochs=20, rate=0.03)
    losses = [x for _, x in net.history]
    assert losses[net.best_epoch] == min(losses) < losses[0] * 0.8
    again = N.train(df, 12, batch=150, hidden=32, epochs=2, rate=0.03)
    assert [x for _, x in again.history] == pytest.approx(losses[:3])
    linear = K.train_heads(df, 12)
    held = df.where("held").select("case_id", F.col("y")[0].cast("int").alias("y"))
    ranked = lambda m: E.auroc(K.predict(df, m, 12).join(held, "case_id"), "prob").first()[0]
    assert ranked(net) > 0.95 > 0.65 > ranked(linear)
    # Nothing to learn from, and nothing held.
    assert N.train(df.limit(0), 12, hidden=4, epochs=2).history == [(0, 0.0)]
    assert len(N.train(df.where("not held").limit(40), 12, hidden=4, epochs=2).history) == 3


def test_network_takes_a_job_per_epoch_not_per_step(spark, monkeypatch):
    """Sums over partitions: one an epoch, whatever the number of mini-batches; more only where a partition would take more than LOCAL steps."""
    seen, whole = [], N.summed
    monkeypatch.setattr(N, "summed", lambda g, parts: seen.append(parts) or whole(g, parts))
    df = spark.createDataFrame(planted(), ROWS)
    net = N.train(df, 12, batch=16, hidden=8, epochs=3)
    assert len(seen) == 3 and len(net.history) == 4 and net.history[3][1] < net.history[0][1]
    monkeypatch.setattr(N, "LOCAL", 2)
    seen.clear()
    N.train(df, 12, batch=16, hidden=8, epochs=2)
    assert len(seen) == 2 * -(-750 // (4 * 16 * 2))


def test_network_trains_on_all_partitions(spark, monkeypatch):
    """Every partition of a round has its share of the rows, and blocks do not depend on where batches end."""
    seen, whole = [], N.summed
    monkeypatch.setattr(N, "summed", lambda g, parts: seen.append((parts, sorted(r["weight"] for r in g.where("chunk = 0").collect()))) or whole(g, parts))
    df = spark.createDataFrame(planted(), ROWS)
    net = N.train(df, 12, batch=16, hidden=8, epochs=1)
    (parts, sizes), *_ = seen
    assert len(sizes) == parts == min(spark.sparkContext.defaultParallelism, 750 // (16 * N.FEWEST)) and sum(sizes) == 750 and sizes[-1] < 1.5 * 750 / parts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert N.train(df, 12, batch=16, hidden=8, epochs=1).flat == pytest.approx(net.flat, abs=1e-7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mean_of_partitions_is_one_pass_where_there_is_one(spark):
    """A round over one partition is Adam over its mini-batches in the order of the rows' hashes."""
    df = spark.createDataFrame(planted(300), ROWS)
    net = N.train(df, 12, batch=1000, hidden=6, epochs=2, dropout=0.0)
    rows = [r for r in df.withColumn("row", F.xxhash64(F.lit(1337), "case_id")).orderBy("row").collect() if not r["held"]]
    x = np.zeros((len(rows), 13), np.float32)
    for k, r in enumerate(rows):
        x[k, r["idx"]], x[k, 12] = 1, 1
    y, w = np.array([r["y"] for r in rows]), np.ones(len(rows))
    start = N.Network.drawn(12, 6)
    own = N.Adam(np.concatenate([start.flat, np.zeros(2 * len(start.flat), np.float32)]), 0, (start.first.shape, start.second.shape), K.RATE, 1e-4, 0.0)
    for _ in range(2):
        own.over([(x, y, w, np.zeros(len(rows)))])
    assert net.best_epoch == 2 and own.model.flat == pytest.approx(net.flat, abs=1e-5)


def test_texts_that_case_folding_need_not_see(spark):
    """Every settled character, by itself and beside each other one, folds to its small letter, so those texts need not reach Python; others fold as before."""
    settled = [c for c in map(chr, range(0x3000)) if re.match(f"[{T.SETTLED}]", c)]
    plain = lambda x: unicodedata.normalize("NFKC", x).casefold()
    pairs = "".join(a + b for a in settled for b in settled)
    assert len(settled) > 400 and plain(pairs) == pairs.lower()
    texts = [*settled, "й", "ﬁne Straße", "Ａ", "ΑΣ", "İ", "…", "", None, "Ё\u0301", "Plain text, ёлка"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    assert {r["k"]: r["v"] for r in df.select("k", T.nfkc_casefold(F.col("x")).alias("v")).collect()} == {k: None if x is None else plain(x) for k, x in enumerate(texts)}


def test_written_tables_use_small_batches(spark):
    """Python gets at most 1000 rows at a time while a table is written; the session's own settings are as before."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = session.materialise(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"))
    assert [r["n"] for r in got.collect()] == [1000] * 5 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    session.drop(got)


def test_attributions_are_input_times_derivative(spark):
    """By finite differences of the risk logit; slots with their dimension, grams by their bucket, each name once, the largest first."""
    rng = np.random.default_rng(2)
    model = N.Network.drawn(6, 5, seed=1)
    model.second[:-1] = rng.normal(size=(5, len(K.HEADS)))
    rows = spark.createDataFrame([(1, [0, 4, 5], [0.5, 0.25, 1.0]), (2, [5], [0.0])], "case_id long, idx array<int>, val array<double>")
    grams = spark.createDataFrame([(1, 1, "ab", 0, -1.0), (1, 2, "ab", 1, 1.0), (1, 3, "cd", 2, 1.0)], "case_id long, pos int, gram string, bucket int, sign double")
    got = N.attributions(rows, model, grams, ("s0", "s1"), ("profit", ""), k=3, buckets=4).orderBy("case_id", "rank").collect()
    x = np.array([[0.5, 0, 0, 0, 0.25, 1.0, 1.0]])
    logit = lambda v: (np.maximum(v @ model.first, 0) @ model.second[:-1] + model.second[-1])[0, 0]
    slope = lambda j: (logit(x + 1e-4 * np.eye(7)[j]) - logit(x - 1e-4 * np.eye(7)[j])) / 2e-4
    want = sorted([("s0", "profit", 0.25 * slope(4)), ("s1", "", slope(5)), ("ab", "", -slope(0)), ("cd", "", slope(2))], key=lambda f: -abs(f[2]))[:3]
    assert [(r["feature"], r["dim"]) for r in got] == [f[:2] for f in want] and [r["rank"] for r in got] == [1, 2, 3]
    assert [r["weight"] for r in got] == pytest.approx([f[2] for f in want], abs=1e-2)


def test_obfuscated_twins(spark):
    """Positives only, with their parents' labels; each word is a parent's word after at most two kinds of change, in either order; draws repeat themselves."""
    rng = np.random.default_rng(3)
    words = ["казино", "заработок", "бонус", "деньги", "money", "да", "успех!", "чаша", ""]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 12)))), k % 2 == 0, 0.1 * (k % 5)) for k in range(900)] + [(900, None, True, 0.5)]
    df = spark.createDataFrame(rows, "case_id long, text string, is_scam boolean, risk double")
    both = K.augmented(df, F.col("is_scam"))
    got = both.collect()
    assert sorted((r["case_id"], r["text"]) for r in got if not r["twin"] and r["text"] is not None) == sorted(r[:2] for r in rows[:-1])
    twins = {r["case_id"]: r for r in got if r["twin"]}
    assert 150 < len(twins) < 225 and len(twins) == sum(r["twin"] for r in got)
    again = {r["case_id"]: r["text"] for r in K.obfuscated_twins(df.repartition(7), F.col("is_scam")).collect()}
    assert again == {k: r["text"] for k, r in twins.items()}
    swaps = dict(zip(K.LOOKALIKE_FROM, K.LOOKALIKE_TO, strict=True)), dict(zip(K.DIGITS_FROM, K.DIGITS_TO, strict=True))

    def forms(word):
        """Patterns of a word after no, one or two kinds of change."""
        one = lambda c: f"[{re.escape(''.join({c, swaps[0].get(c, c), swaps[1].get(c, c)}))}]"
        twice = lambda p, c: f"(?:{p}){{1,2}}" if c.isalpha() else p
        yield "".join(map(one, word))  # look-alikes, digits
        for m in swaps:
            each = [f"[{re.escape(''.join({c, m.get(c, c)}))}]" for c in word]
            yield "".join(map(twice, each, word))
            for sep in K.SEPARATORS:
                yield re.escape(sep).join(each)
        for sep in K.SEPARATORS:
            s = f"(?:{re.escape(sep)})?"
            yield s.join(f"{re.escape(c)}(?:{s}{re.escape(c)})?" if c.isalpha() else re.escape(c) for c in word)

    changed = emoji = total = 0
    for k, twin in twins.items():
        parent = rows[k]
        assert parent[2] and (twin["is_scam"], twin["risk"]) == parent[2:]
        rest = "".join(f"({'|'.join(dict.fromkeys([re.escape(w), *(forms(w) if len(w) >= 4 else [])]))})( (?:{'|'.join(K.EMOJI)}))?" + (" " if n < len(parent[1].split(" ")) - 1 else "") for n, w in enumerate(parent[1].split(" ")))
        m = re.fullmatch(rest, twin["text"])
        assert m, (parent[1], twin["text"])
        found = m.groups()
        changed += sum(a != w for a, w in zip(found[::2], parent[1].split(" "), strict=True) if len(w) >= 4)
        total += sum(len(w) >= 4 for w in parent[1].split(" "))
        emoji += sum(e is not None for e in found[1::2])
    assert 0.3 < changed / total < 0.6 and emoji > 50


def test_separators(spark):
    """By a plain walk: a run between two letters goes, other runs are one space, the rest that is no letter too."""
    seps = " .-_*·•|/\\\u200b\u200c\u200d\u2060\t\n\u00a0\u2003\x1c"
    letter = lambda c: c in "abcdefghijklmnopqrstuvwxyzёәғқңөұүһіІ" or "а" <= c <= "я"

    def plain(text):
        out, i = [], 0
        while i < len(text):
            if text[i] not in seps:
                out.append(text[i])
                i += 1
                continue
            j = i
            while j < len(text) and text[j] in seps:
                j += 1
            out.append("" if i and letter(text[i - 1]) and j < len(text) and letter(text[j]) else " ")
            i = j
        return " ".join("".join(c if letter(c) else " " for c in "".join(out)).split())

    texts = ["к а з и н о", "к.а-з_и*н·о даром", "две части", "a b cd e", "x--y", "", "12 a 3", "б•о|н/у\\с и ещё", "к\u200bа\u200bз\u2060и\u00a0н\u2003о\x1cя", "конец. Новая а", " a ", "né á 7 8.b", "a. 1 .b"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.collapse_separators(F.col("t")).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [plain(t) for t in texts]
    assert one(spark, T.skeleton(F.lit("К А 3 И Н 0 даром! Ｆｒｅｅ"))) == plain("к а 3 и н 0 даром! free".translate(str.maketrans(T.CONFUSABLE_FROM, T.CONFUSABLE_TO)))


def test_patterns_that_run_over_classes(spark):
    """No search for what is outside of a class, which is slow in Java's matcher; results are those of such a search."""
    texts = ["К а 3 И Н 0 даром!", "ｆｒｅｅ", "a\u2003b", "", None, "ß", "é", "a\nb\n", "«x» — y", "😀 a", "a.😀.b", "..a.-b..", "\n", "x\u200b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = F.col("t")
    old = F.trim(F.regexp_replace(F.regexp_replace(t, rf"(?U)(?<=[{T.LETTERS}])[{T.SEPARATORS}]+(?=[{T.LETTERS}])", ""), f"[^{T.LETTERS}]+", " "))
    both = df.select(T.collapse_separators(t).alias("new"), old.alias("old"), T.nfkc_casefold(t).alias("folded"), "t").collect()
    assert [r["new"] for r in both] == [r["old"] for r in both]
    assert [r["folded"] for r in both] == [None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in texts]
    plan = df.select(T.skeleton(t))._jdf.queryExecution().executedPlan().toString()
    assert "[^" not in plan


def test_hashed_features_and_vectors(spark):
    """Signed sums by bucket, of length 1 per case; slots come behind the buckets; a case without grams has its slots only."""
    grams = [(1, "a"), (1, "a"), (1, "b"), (1, "c d"), (2, "a")]
    df = spark.createDataFrame(grams, "case_id long, gram string")
    where = {r["gram"]: (r["b"], r["s"]) for r in df.select("gram", K.bucket_of(F.col("gram"), 16).alias("b"), K.sign_of(F.col("gram")).alias("s")).distinct().collect()}
    want = {}
    for case, g in grams:
        want.setdefault(case, {}).setdefault(where[g][0], []).append(where[g][1])
    sums = {c: {b: sum(v) for b, v in at.items() if sum(v)} for c, at in want.items()}
    norm = {c: sum(v * v for v in at.values()) ** 0.5 for c, at in sums.items()}
    hashed = K.hashed_features(df, 16)
    got = {(r["case_id"], r["bucket"]): r["value"] for r in hashed.collect()}
    assert got == pytest.approx({(c, b): v / norm[c] for c, at in sums.items() for b, v in at.items()})
    slots = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.25, 1.0), (3, 0.0, 0.75)], "case_id long, s0 double, s1 double")
    rows = {r["case_id"]: dict(zip(r["idx"], r["val"], strict=True)) for r in K.vectors(hashed, slots, 16).collect()}
    assert rows[3] == {16: 0.0, 17: 0.75}
    assert rows[2] == pytest.approx({where["a"][0]: where["a"][1], 16: 0.25, 17: 1.0})
    assert rows[1] == pytest.approx({b: v / norm[1] for b, v in sums[1].items()} | {16: 0.5, 17: 0.0})


def test_char_gram_counts(spark):
    """By a plain count, also over several pieces; a word as long as a text (600,000 letters) is counted in one pass."""
    texts = ["казино казино дом", "дом a", None, "", "і ё", "free ғқ"]
    want = Counter(f" {w} "[a : a + n] for t in texts if t for w in t.split() for n in (3, 4, 5) for a in range(len(w) + 3 - n))
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    assert {r["gram"]: r["n"] for r in X.char_gram_counts(df).collect()} == want
    pieces: Counter = Counter()
    for t in texts:
        for grams, times in X._windows([t or ""]):
            pieces.update(dict(zip(grams.tolist(), times.tolist(), strict=True)))
    assert pieces == want
    long = X.char_gram_counts(spark.createDataFrame([("аб" * 300_000,)], "s string"))
    assert {r["gram"]: r["n"] for r in long.collect()}["аба"] == 299_999


def test_hashed_rows_count_within_their_row(spark):
    """As by way of ``hashed_features``, also for a case of several rows and for null, empty and cancelling grams; what is shuffled is a row per text, not per gram."""
    grams = [f"g{k}" for k in range(40)]
    data = [(1, ["a", "a", "b", "c d"]), (2, grams), (2, grams[5:] + ["a"]), (3, []), (4, None), (5, ["x"] * 3 + grams)]
    df = spark.createDataFrame(data, "case_id long, grams array<string>")
    want = {r["case_id"]: (r["idx"], r["val"]) for r in K.sparse_rows(K.hashed_features(df.select("case_id", F.explode("grams").alias("gram")), 16)).collect()}
    rows = K.hashed_rows(df, 16)
    got = {r["case_id"]: (r["idx"], r["val"]) for r in rows.collect()}
    assert {c: v for c, v in got.items() if v[0]} == want
    assert set(got) == {1, 2, 3, 4, 5} and not got[3][0] and not got[4][0]
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert not K.hashed_rows(df.limit(0), 16).collect()


def test_word_grams_are_hashed_in_one_pass(spark, monkeypatch):
    """As Spark hashes them, for pieces of every length to 70 bytes and longer ones, in both alphabets; the vectors are those of the grams one by one, also in several slices and for cases of several rows."""
    rng = random.Random(8)
    pieces = ["", *("".join(rng.choices("aя9#ғ", k=n)) for n in range(1, 36) for _ in range(3)), "word" * 50, "слово" * 999]
    data = "".join(pieces).encode()
    ends = np.cumsum([len(x.encode()) for x in pieces])
    got = X.xxhash64(np.frombuffer(data, np.uint8), np.append(0, ends[:-1]), ends, X.seed_of(3)).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(pieces)), "k int, x string").select("k", F.xxhash64(F.lit(3), "x").alias("h"))
    assert got == [r["h"] for r in df.orderBy("k").collect()]
    texts = [(1, "Крутим Барабаны, без риска: WIN777 win777"), (1, "ещё раз"), (2, None), (3, ""), (4, "…!"), (5, "ﬁne Ａbc Straße İx Kelvin"), (6, "один"), *((k, " ".join(rng.choices(pieces[1:], k=k))) for k in range(7, 60))]
    df = spark.createDataFrame(texts, "case_id long, text string")
    want = K.hashed_rows(df.select("case_id", T.word_ngrams(T.folded_words(F.col("text"))).alias("grams")), 64)
    want = {r["case_id"]: (r["idx"], pytest.approx(r["val"])) for r in want.collect()}
    for rows, characters in ((256, 1 << 20), (5, 1 << 20), (256, 300)):
        monkeypatch.setattr(K, "ROWS", rows)
        monkeypatch.setattr(K, "CHARACTERS", characters)
        found = K.hashed_texts(df, 64)
        assert {r["case_id"]: (r["idx"], r["val"]) for r in found.collect()} == want and len(want) == 59
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and "regexp_extract_all" not in plan


LABEL = "case_id long, risk double, is_scam boolean, weight double, category string, " + ", ".join(f"{d} double" for d in config.DIMENSIONS)


def test_labels(spark):
    """Hand-made labels win and take their dimensions from the rules; the training table is clipped, indexed, and whole; a teacher's predictions are labels too."""
    weak = spark.createDataFrame([(1, 0.4, False, 0.5, "no_violation", *[0.1] * 8), (2, 0.7, True, 0.3, "investment_scam", *[0.2] * 8)], LABEL)
    given = spark.createDataFrame([(2, 0.9, True, "financial_pyramid"), (5, 1.4, True, "unheard")], "case_id long, risk double, is_scam boolean, category string")
    merged = K.merge_labels(weak, K.hand_labels(given, weak))
    got = {r["case_id"]: (r["source"], r["risk"], r["weight"], r["profit"], r["category"]) for r in merged.collect()}
    assert got == {1: ("weak", 0.4, 0.5, 0.1, "no_violation"), 2: ("gold", 0.9, 1.0, 0.2, "financial_pyramid"), 5: ("gold", 1.4, 1.0, 0.0, "unheard")}
    table = {r["case_id"]: (r["y"], r["profit"], r["category"], r["weight"]) for r in K.training_table(spark.range(1, 7).withColumnRenamed("id", "case_id"), merged).collect()}
    index = K.CATEGORY_NAMES.index
    assert table == {1: (0.4, 0.1, index("no_violation"), 0.5), 2: (0.9, 0.2, index("financial_pyramid"), 1.0), 3: (0.0, 0.0, 0, 0.0), 4: (0.0, 0.0, 0, 0.0), 5: (1.0, 0.0, 0, 1.0), 6: (0.0, 0.0, 0, 0.0)}
    guess = spark.createDataFrame([(1, 0.8, "no_violation", 0.1, *[50] * 8)], "case_id long, prob double, category string, confidence double, " + ", ".join(f"{d} int" for d in config.DIMENSIONS))
    soft = K.soft_targets(guess).first()
    assert (soft["risk"], soft["is_scam"], soft["weight"], soft["category"], soft["urgency"]) == (0.8, True, 0.2, "no_violation", 0.5)
    assert sorted(K.targets(K.soft_targets(guess)).first()["y"][:2]) == [0.5, 0.8]


def test_drift_against_a_stored_baseline(spark):
    """By numpy: shares in the baseline's deciles; constant features; a feature that is gone later."""
    rng = np.random.default_rng(4)
    before = {"a": rng.normal(size=500), "b": np.zeros(500), "c": rng.random(500)}
    after = {"a": rng.normal(0.8, 1, 300), "b": np.zeros(300)}
    rows = lambda d: spark.createDataFrame([(k, float(x)) for k, xs in d.items() for x in xs], "feature string, v double")
    base = E.drift_baseline(rows(before))
    want = {}
    for k, xs in before.items():
        edges = np.unique(np.quantile(xs, np.arange(1, 10) / 10))
        count = lambda ys: np.bincount(np.searchsorted(edges, ys, "left"), minlength=len(edges) + 1)  # noqa: E731, B023
        shares = [np.maximum(count(ys) / max(1, len(ys)), 1e-4) for ys in (xs, after.get(k, np.zeros(0)))]
        b, c = (s / s.sum() for s in shares)
        want[k] = float(((c - b) * np.log(c / b)).sum())
    psi = E.psi_to(base, rows(after))
    got = {r["feature"]: (r["psi"], r["constant"]) for r in psi.collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and {k for k, v in got.items() if v[1]} == {"b"}
    report = E.drift_report(psi, most=2).collect()
    assert [r["feature"] for r in report] == sorted(want, key=want.get)[::-1][:2] and report[0]["n_flagged"] == sum(v > 0.2 for v in want.values())


def test_versions(spark):
    """Newest first within each model, ties by version; going back to a version makes it the active one; one that is not there changes nothing."""
    rows = [("m", v, v // 2, float(v)) for v in range(9)] + [("n", 3, 7, 1.0)]
    versions = spark.createDataFrame(rows, "model string, version int, activated_at long, metric double")
    got = sorted((r["model"], r["place"], r["version"]) for r in C.list_versions(versions).collect())
    assert got == [("m", k, 9 - k) for k in range(1, 10)] + [("n", 1, 3)]
    wanted = spark.createDataFrame([("m", 4), ("n", 99)], "model string, version int")
    assert sorted((r["model"], r["active"]) for r in C.active_versions(C.roll_back(versions, wanted, F.lit(1 << 40))).collect()) == [("m", 4), ("n", 3)]


def test_nodes_in_order(spark):
    """n2 stands before n10, the case itself first."""
    from riskspark.operators import documents as D

    nodes = spark.createDataFrame([(1, f"n{k}", "hashtag", "x") for k in (10, 2, 1, 11)] + [(1, "v1", "video", "y")], "case_id long, id string, type string, label string")
    edges = spark.createDataFrame([(1, f"e{k}", "v1", f"n{k}", "hashtag") for k in (10, 2, 1, 11)], "case_id long, id string, source string, target string, type string")
    posts = spark.createDataFrame([(1, "t", None)], "case_id long, title string, created date")
    cases = spark.createDataFrame([(1, 1, "low", "no_violation", "")], "case_id long, score int, level string, category string, reason string")
    dims = spark.createDataFrame([(1, 0, "profit", 3)], "case_id long, dim_no int, dim string, value int")
    timeline = spark.createDataFrame([], "case_id long, id string")
    cards = [spark.createDataFrame([], "case_id long, type string")]
    doc = D.case_documents(posts, cases, dims, timeline, cards, nodes, edges).first()
    assert [n["id"] for n in doc["nodes"]] == ["v1", "n1", "n2", "n10", "n11"] and [e["id"] for e in doc["edges"]] == ["e1", "e2", "e10", "e11"]


def test_sampling_plan(spark):
    df = spark.createDataFrame([(k, "ab"[k % 10 == 0]) for k in range(5000)], "id long, s string")
    plan = K.sampling_plan(df, "s")
    assert sorted((r["s"], r["n"], r["quota"]) for r in plan.collect()) == [("a", 4500, 500), ("b", 500, 500)]
    taken = K.balanced_sample(df, "id", "s", plan).groupBy("s").count().collect()
    assert all(abs(r["count"] - 500) < 90 for r in taken)


def test_components_of_a_graph(spark):
    links = [(1, 2), (2, 3), (5, 6), (9, 7), (7, 8), (3, 9)]
    got = {r["case_id"]: r["cluster"] for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 5: 5, 6: 5}


def test_no_private_folder_on_a_cluster():
    """Off a local master a session without a checkpoint folder is told so."""

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError):
        session.shared_folder(Session)


def test_links_are_looked_for_where_they_may_be(spark):
    odd = ["", None, "İ K z.lınk q.linK y.SITE/ab", "@abct.me/xyzw t.me/Kabc", "WHATſAPP: 12345678 wa.me/77011234567", "whatsapp\n+7 701-123-45-67", "bonuſ: ABC promo  CODE-XY1 кᲂд abc9 ПРОМОКОД:win777 коᲁ ZZ9", "https://bit.ly/x,http://cutt.ly a@bc.vk.cc goo.gl 1.bio.click"]
    texts = spark.createDataFrame([(x,) for x in odd], "t string")
    for kind, regex, *_ in config.LINKS:
        plain = F.regexp_extract_all("t", F.lit("(?iu)" + regex), F.lit(1))
        got = texts.select(F.coalesce(plain, F.array().cast("array<string>")).alias("a"), F.coalesce(M.link_values(F.col("t"), kind, regex), F.array().cast("array<string>")).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]
    # A long word that is no address costs its length, not the square of it.
    began = time.time()
    assert spark.createDataFrame([("a" * 400_000,)], "t string").select(F.size(M.link_values(F.col("t"), *config.LINKS[4][:2]))).first()[0] == 0
    assert time.time() - began < 20


def test_characters_are_counted_in_one_pass(spark, monkeypatch):
    odd = ["İK ж", "Ғ hello", "ҒЫЛЫМ", "аб ab", None, "", "\u200b\U0001f300\U0001faff\U0001fb00☀➿ 12", "٣4 Åſ"]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    both = rows.select(T.language_hint(F.col("t")), T.digit_ratio(F.col("t")), T.emoji_share(F.coalesce("t", F.lit(""))))
    assert [tuple(r) for r in both.collect()] == [("mixed", 0.0, 0.0), ("en", 0.0, 0.0), ("kz", 0.0, 0.0), ("mixed", 0.0, 0.0), ("", 0.0, 0.0), ("", 0.0, 0.0), ("", 2 / 9, 0.25), ("", 1 / 5, 0.0)]
    assert "regexp" not in both._jdf.queryExecution().toString()
    monkeypatch.setattr(T, "COUNTED_AT_ONCE", 3)
    n = T.character_counts.func(pa.array(["аб1", None, "", "x", "Қ2"])).to_pylist()
    assert [None if r is None else tuple(r.values()) for r in n] == [(2, 0, 0, 1, 0), None, (0,) * 5, (0, 1, 0, 0, 0), (0, 0, 1, 1, 0)]


def test_a_partition_of_training_is_one_task(spark, monkeypatch):
    """Files above the session's most bytes of a task are not cut, so no round has a second wave of tasks; the settings are put back."""
    seen, whole = [], N.summed
    monkeypatch.setattr(N, "summed", lambda g, parts: seen.append(parts) or whole(g, parts))
    df = spark.createDataFrame(planted(), ROWS)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    want, heads = N.train(df, 12, batch=16, hidden=8, epochs=1), K.train_heads(df, 12, epochs=1, parts=3)
    try:
        for k in names:
            spark.conf.set(k, "1000")
        assert N.train(df, 12, batch=16, hidden=8, epochs=1).flat == pytest.approx(want.flat, abs=1e-6)
        assert K.train_heads(df, 12, epochs=1, parts=3).weights == pytest.approx(heads.weights, abs=1e-6)
        assert [spark.conf.get(k) for k in names] == ["1000", "1000"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen == [min(spark.sparkContext.defaultParallelism, 750 // (16 * N.FEWEST))] * 2


def test_quicker_patterns_find_the_same(spark):
    """Anchors, tags, knowledge-base texts and links as by the plain expressions, over odd texts; no text is looked up character by character or cut into all its words."""
    odd = ["", "Double YOUR cash, dоивlе уоиг саsн дОИВlе", "УДВОИМ вклад, уdв0им вkлаd удвоим вкладудвоим вклад", "İK ΑΣ капает на карту", "#Тег_а,#b  x#c\t#d\n##e # #ё_Ё", "Ёлка ё \u0301", "tel 8(701) 123-45-67 +7 70 1 2", "+1234567890", "12345678901 1 2 3 4 5 6 7 8 9", "@ab_cd T.ME/Xyz1 telegram.ME/Kabc a/b/c", "a.b.bit.ly/x\u00a0y cutt.ly\u2003z .site x.Link/?q", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "case_id int, t string").where("t is not null")
    t, anchors = F.col("t"), ("удвоим вклад", "капает на карту", "dоивlе уоиг саsн")
    plain = sum(((F.length(T.fold_lookalikes(t)) - F.length(F.replace(T.fold_lookalikes(t), F.lit(a), F.lit("")))) / len(a) for a in anchors), F.lit(0.0))
    pairs = [(F.least(plain, F.lit(5.0)) / 5.0, T.anchor_density(t, anchors)), (F.translate(F.lower(F.trim(t)), "ё", "е"), T.kb_text(t))]
    pairs += [(F.regexp_extract_all(t, F.lit("(?iu)" + regex), F.lit(1)), M.link_values(t, kind, regex)) for kind, regex, *_ in config.LINKS]
    for a, b in pairs:
        rows = df.select(a.alias("a"), b.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows]
    posts = df.select("case_id", F.lit(None).cast("string").alias("title"), t.alias("description"), F.lit("#z,#Z").alias("tags"))
    prints = S.fingerprint(posts, spark.createDataFrame([], "case_id int, kind string, value string"))
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "title", "description", "tags")), r"[ ,\n\t\r]+"), lambda w: w.startswith("#"))
    want = {r["case_id"]: r["v"] for r in posts.select("case_id", F.array_distinct(F.filter(F.transform(words, T.kb_tag), lambda x: x != "")).alias("v")).collect()}
    assert {r["case_id"]: r["tags"] for r in prints.collect()} == want and any(len(v) > 3 for v in want.values())
    plan = prints._jdf.queryExecution().executedPlan().toString() + df.select(T.anchor_density(t, anchors))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "translate(" not in plan
    assert all(M.fold(x) == "".join(map(M._fold_one, x)) for x in odd if x)


def test_texts_with_words(spark):
    """As the words say; no word is made for it."""
    texts = spark.createDataFrame([(x,) for x in ("", None, "…!", "Ａ", "№ 5", "Ёж", "ﬁ", "Ω", "#", "李", "İ")], "t string")
    both = texts.select(F.coalesce(F.size(T.folded_words(F.col("t"))) > 0, F.lit(False)).alias("a"), F.coalesce(T.has_words(F.col("t")), F.lit(False)).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] and {r["a"] for r in both} == {True, False}


def test_wide_dimensions_in_one_aggregate(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    hits = spark.createDataFrame([(1, "profit", 60.0), (1, "profit", 70.0), (1, "negative", 40.0), (2, "reused", 10.0), (2, "gambling", None), (9, "profit", 50.0)], "case_id long, dim string, confidence double")
    images = spark.createDataFrame([(1, "gambling", 0.5), (2, "", 0.9)], "case_id long, dim string, score double")
    kb = spark.createDataFrame([(1, 0), (2, 33), (3, 20)], "case_id long, kb_score int")
    dims = spark.createDataFrame(list(enumerate(config.DIMENSIONS)), "dim_no int, dim string")
    want = S.wide(S.raise_reused(S.dimensions(cases, hits, images, dims), kb)).join(S.negatives(hits), "case_id", "left").orderBy("case_id")
    got = S.wide_dimensions(cases, hits, images, kb).orderBy("case_id")
    assert got.dtypes == want.dtypes and got.collect() == want.collect()
    assert "Generate" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
