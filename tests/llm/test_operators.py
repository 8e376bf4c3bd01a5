"""The text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskspark.llm import bpe, exact_dedup, fingerprints, language_id, lm_scoring, mixing, near_dedup, pii, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, vertex int, key int, size int, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows(seed=1, n=90):
    """Texts with copies, near copies, nulls, empty ones, a very long one and repeated rows; other columns clash with inner names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    texts = []
    for k in range(n):
        if k % 9 == 0:
            texts.append(None if k % 18 else "")
        elif k % 5 == 0 and k > 10:
            texts.append(texts[k - 3])
        elif k % 7 == 0 and k > 10 and texts[k - 2]:
            words = texts[k - 2].split(" ")
            words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40, 120]))) + rng.choice([".", "\n", "!"]))
    texts[4] = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    out = [(k, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None]), 1, 2, 3, 4) for k, t in enumerate(texts)]
    return [*out, out[5], out[5], out[0]]


@pytest.fixture(scope="module")
def table(spark):
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(spark, docs, table, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(table)
    sizes = collections.Counter()
    for _, t, _, s, *_ in table:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:  # water filling, round by round
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 * largest[s] + 1e-6
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.take(docs).columns == docs.columns
    assert mixing.take(docs).count() == sum(r["copies"] for r in got if r["taken"])


def test_mixing_keys(spark, monkeypatch):
    """A null source is not the source "\\x00", and clashing hashes merge nothing."""
    data = [(k, "w " * (1 + k % 5), None, None if k % 2 else "\x00", 0, 0, 0, 0) for k in range(40)]
    data += [(k // 2 * 2, "w " * (1 + k // 2 * 2 % 5), None, None, 0, 0, 0, 0) for k in range(20)]
    docs = spark.createDataFrame(data, SCHEMA)
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(mixing.F, "xxhash64", lambda *columns: F.lit(5).cast("long"))
        got = mixing.mix_sources(docs).collect()
        assert len(got) == len(data)
        for source in (None, "\x00"):
            mine = [r for r in got if r["source"] == source]
            assert len(mine) == sum(x[3] == source for x in data)
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3 * 2 * 5
        assert mixing.take(docs).count() == sum(r["copies"] for r in got)


def test_exact_dedup(spark, docs, table, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = collections.defaultdict(list)
    for d, t, *_ in table:
        groups[t or ""].append(d)
    want = sorted((d, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in table)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_clashing_digests(spark, docs):
    """Identifiers are verified: with digests of one byte, which clash, the result is the same."""
    want = sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    assert exact_dedup._clashes(texts, 1).count() > 0
    assert sorted(map(str, exact_dedup.exact_duplicates(docs.repartition(7), digest_bytes=1).collect())) == want


def test_near_dedup(spark, docs, table, empty):
    sets = {}
    for d, t, *_ in table:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted((d, len(sets[d]), root(d)) for d, *_ in table)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.select("doc_id").distinct().count() == len({root(d) for d in sets})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_of_a_chain(spark):
    """Documents linked only through one another form one component, whatever the star centres are."""
    words = [f"w{k}" for k in range(400)]
    chain = [(k, " ".join(words[6 * k : 6 * k + 100]), "en", "a", 0, 0, 0, 0) for k in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(chain, SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_index_guarantee():
    """Signatures that differ in at most 23 positions share a key."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 65536, near_dedup.POSITIONS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(near_dedup.POSITIONS, 23, replace=False)] ^= 1
        keys = near_dedup.index_keys(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_wide_distance():
    rng = np.random.default_rng(5)
    fields = rng.integers(0, 4, (6, near_dedup.WIDE), np.uint8)
    packed = (fields.reshape(6, -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8).view(np.uint64)
    assert near_dedup.wide_distance(packed[0], packed).tolist() == [(fields[0] != f).sum() for f in fields]


def test_fingerprints(spark, docs, table, empty):
    ordered = sorted(table, key=lambda r: (r[0], r[1] or ""))
    want = []
    for k, r in enumerate(ordered):
        t, nxt = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest(), fingerprints.fingerprint(t)))
    for size in (4096, 7):
        got = fingerprints.compare_with_next(docs, rows_per_bucket=size).collect()
        assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got) == sorted(want)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.compare_with_next(empty).count() == 0
    text = "\n".join(f"Line number {k} says something else." for k in range(200))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(text.replace("number 100 ", "number one hundred "))
    assert fingerprints.likeness(a, a) == 1.0
    assert 0.98 < fingerprints.likeness(a, b) < 1.0
    assert len(fingerprints.edits(a, b)) == 1


def test_sharding(spark, docs, table, empty):
    got = sharding.external_shuffle(docs, 8, bucket_bytes=20_000).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [(r[0], r[1]) for r in table]))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["__shard"]].append(r["__slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.external_shuffle(docs.repartition(6), 8, bucket_bytes=20_000).collect()
    key = lambda r: (r["doc_id"], r["__shard"], r["__slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.external_shuffle(empty).count() == 0
    order = sharding.fisher_yates(1000, 5)
    assert sorted(order) == list(range(1000))
    assert list(order) != list(range(1000))


def test_write_shards(spark, docs, table, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(table)


def toxic_rows(n=400):
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    out, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zonkard", "zonkest", "zonkish"])
        out.append((k, " ".join(words), "en", "a", 0, 0, 0, 0))
        labels.append((k, 1 if toxic else 0))
    return [*out, (n, None, "en", "a", 0, 0, 0, 0), (n + 1, "", "en", "a", 0, 0, 0, 0)], labels


def test_token_tags_in_slices():
    """The sample is worked on in slices of whole documents: the tags are those of one pass, the memory is not that of the whole."""
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 900, 2000)
    doc, toxic = np.repeat(np.arange(2000), lengths), rng.random(2000) < 0.3
    features = np.minimum(rng.geometric(0.0005, (len(doc), 4)), toxicity.BINS - 1).astype(np.int32)
    features[toxic[doc] & (rng.random(len(doc)) < 0.01), 0] = 99_999
    tracemalloc.start()
    tags = toxicity.token_tags(features, doc, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # one pass took over 80 bytes a token
    assert (tags == (toxic[doc] & (features == 99_999).any(1))).all() and tags.any()
    parts = list(toxicity.whole_documents(doc, 1000))
    assert parts[0].start == 0 and parts[-1].stop == len(doc) and all(a.stop == b.start and doc[a.stop - 1] < doc[b.start] for a, b in zip(parts, parts[1:]))


def test_toxicity(spark, empty):
    docs, labels = toxic_rows()
    truth = dict(labels)
    df, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == len(docs)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] in truth]
    assert sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    texts = {d: t for d, t, *_ in docs}
    found = [texts[r["doc_id"]][int(a) : int(b)] for r in got for s in r["spans"].split(",") if s for a, b in [s.split(":")]]
    assert found
    assert sum("zonk" in f for f in found) / len(found) > 0.9
    assert toxicity.score_documents(empty, model).count() == 0
    nothing = toxicity.fit(df, marks.limit(0), F.lit(True))
    assert all(r["score"] < 0.3 for r in toxicity.score_documents(df, nothing).collect())


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    emission, move = rng.normal(size=6), rng.normal(size=(2, 2))
    p, pairs, log_z = toxicity.marginals(emission, move, np.zeros(6, int), np.arange(6))
    total, want, both = 0.0, np.zeros(6), np.zeros((2, 2))
    for path in range(64):
        tags = [(path >> k) & 1 for k in range(6)]
        w = math.exp(sum(e * t for e, t in zip(emission, tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        want += w * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            both[a, b] += w
    assert np.allclose(p, want / total)
    assert np.allclose(pairs, both / total)
    assert log_z == pytest.approx(math.log(total))


def test_long_chains(monkeypatch):
    """A chain far longer than the others, worked on token by token at its end, against all chains together."""
    rng = np.random.default_rng(4)
    lengths = [3, 400, 1, 57, 8, 2]
    n = sum(lengths)
    chain, place = np.repeat(np.arange(6), lengths), np.concatenate([np.arange(x) for x in lengths])
    emission, move = rng.normal(size=n), rng.normal(size=(2, 2))
    few = toxicity.marginals(emission, move, chain, place)
    monkeypatch.setattr(toxicity, "TOGETHER", 1)
    every = toxicity.marginals(emission, move, chain, place)
    assert np.allclose(few[0], every[0]) and np.allclose(few[1], every[1]) and few[2] == pytest.approx(every[2])
    alone = toxicity.marginals(emission[3:403], move, np.zeros(400, int), np.arange(400))
    assert np.allclose(few[0][3:403], alone[0])


def test_language_id(spark, empty):
    rng = random.Random(5)
    sounds = {"en": ["the", "ing", "wh", "th"], "de": ["sch", "ung", "ei", "ch"], "fr": ["eau", "oi", "que", "é"], "es": ["ción", "os", "ar", "ll"]}
    docs = [(k, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(30)), lang, "a", 0, 0, 0, 0) for k in range(240) for lang in [rng.choice(list(sounds))]]
    docs += [(900, None, None, "a", 0, 0, 0, 0), (901, "12 34 !!", "en", "a", 0, 0, 0, 0), (902, "", None, "a", 0, 0, 0, 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    model = language_id.fit(df, language_id.learning())
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1 and d[0] < 900]
    assert sum(got[d[0]]["lang_pred"] == d[2] for d in held) / len(held) > 0.95
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(240))
    assert language_id.predict(empty, model).count() == 0
    assert language_id.fit(empty, F.lit(True)) is None


def test_lm_scoring(spark, docs, table, empty):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    words = [[*WORD.findall(lower(t)), None] for _, t, *_ in table]
    counts = collections.Counter()
    for (d, *_), w in zip(table, words):
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted((d, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for (d, *_), w in zip(table, words))
    got = lm_scoring.score_documents(docs, learn).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert lm_scoring.score_documents(empty, learn).count() == 0


def test_tree_sums_to_one(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["a b c", "a b d", "x y", "c a"]) for _ in range(4000))
    tree, counts = lm_scoring.fit(spark.createDataFrame([(text,)], "text string"))
    assert any(len(node[1]) for node in tree.nodes)
    words = np.array([r["k0"] for r in counts.collect()], np.int64).astype(np.uint64)
    for history in (["a"], ["a", "b"], ["x"], ["c", "a", "b"]):
        data = np.frombuffer(" ".join(history).encode(), np.uint8)
        past = lm_scoring.word_hashes(data, np.array([0, len(data)]))[0]
        total = 0.0
        for word in words:
            symbols = np.append(past, word)
            row, p = tree.probabilities(symbols, np.arange(len(symbols)))
            total += p[-1]
        # What is left is the one unknown word.
        rest = 1.0
        for k in range(len(tree.nodes)):
            if len(past) > k:
                node = tree.nodes[k][0].find(lm_scoring.contexts(np.append(past, np.uint64(9)), k + 1)[-1:])[0]
                rest *= tree.nodes[k][1][node] if node >= 0 else 1.0
        assert total + rest / tree.scale == pytest.approx(1.0, abs=1e-6)


def brute_tree(texts, least=3, depth=3, divergence=20.0, discount=0.5):
    """Probability of a token given what came before it, by plain dictionaries."""
    seqs = [[*WORD.findall(lower(t)), None] for t in texts]
    grams = [collections.Counter(tuple(s[i - n + 1 : i + 1]) for s in seqs for i in range(n - 1, len(s))) for n in range(1, depth + 2)]
    total, distinct = sum(grams[0].values()), len(grams[0])
    kept = {}

    def p(word, past):
        for d in range(min(depth, len(past)), 0, -1):
            node = kept.get(tuple(past[-d:]))
            if node:
                return node[0].get(word, None) or p(word, past[len(past) - d + 1 :]) * node[1]
        return (grams[0][(word,)] + 1) / (total + distinct + 1)

    for d in range(1, depth + 1):
        found = collections.defaultdict(dict)
        for g, c in grams[d].items():
            if c >= least:
                found[g[:-1]][g[-1]] = c
        new = {}
        for context, symbols in found.items():
            size = grams[d - 1][context]
            q = {w: (c - discount) / size for w, c in symbols.items()}
            low = {w: p(w, list(context[1:])) for w in symbols}
            rest, rest_below = max(1 - sum(q.values()), 1e-12), max(1 - sum(low.values()), 1e-12)
            if size * (sum(x * math.log(x / low[w]) for w, x in q.items()) + rest * math.log(rest / rest_below)) >= divergence and sum(low.values()) < 1:
                new[context] = (q, rest / rest_below)
        kept |= new
    return p, kept


def test_tree_grows_with_the_corpus(spark, monkeypatch):
    """A strong context of 4 occurrences counts the same in a small and in a large corpus, in the broadcast head or outside it."""
    rng = random.Random(8)
    strong = "alpha beta gamma delta"
    texts = [strong] * 4 + [" ".join(rng.choice(["a b c", "a b d", "x y", "c a", f"w{rng.randrange(900)}"]) for _ in range(60)) for _ in range(150)]
    p, kept = brute_tree(texts)
    assert ("gamma",) in kept and any(len(x) > 1 for x in kept)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: sum(math.log10(p(w, s[:i])) for i, w in enumerate(s)) for k, t in enumerate(texts) for s in [[*WORD.findall(lower(t)), None]]}
    # As if the corpus were large: nothing but the most frequent sequences is in the head; later, a bitmap so small that it drops nearly nothing.
    for head, share, bits in ((2e-7, 1e-6, 27), (1e-2, 1e-2, 27), (1e-2, 1e-2, 6)):
        for name, value in (("HEAD", head), ("SHARE", share), ("BITS", bits)):
            monkeypatch.setattr(lm_scoring, name, value)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(df, F.lit(True)).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_no_share_of_the_corpus(spark):
    """Among two million tokens the context of 4 occurrences is still there."""
    df = spark.createDataFrame([("alpha beta gamma delta",)] * 4 + [("q " * 200_000,)] * 10, "text string").repartition(4)
    tree, words, weights = lm_scoring._fit(df)
    past = lm_scoring.word_hashes(np.frombuffer(b"alpha beta gamma delta", np.uint8), np.array([0, 22]))[0]
    assert weights.where(F.col("key") == int(lm_scoring.grams(past, 2)[1][1].astype(np.int64))).count() == 1


def test_bpe(spark, docs, table, empty):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(4)
    odd = ["".join(rng.choice("aab  \n\t'sé ÃÂ=-. 12²你😀\x1c\xa0　") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    odd += ["a" * 3000, "ÃÂ" * 900, "=" * 700, "x<|endoftext|>y", "the" * 800]
    extra = spark.createDataFrame([(1000 + k, t, "en", "a", 0, 0, 0, 0) for k, t in enumerate(odd)], SCHEMA)
    everything = docs.unionByName(extra)
    got = bpe.encode_documents(everything, with_ids=True).collect()
    texts = collections.defaultdict(set)
    for r in everything.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    for r in got:
        ids = [reference.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert r["ids"] in ids
        raw = np.array(r["ids"], "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(r["ids"]), hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(extra, with_ids=True)).collect()}
    assert all(back[1000 + k] == t for k, t in enumerate(odd))


def test_streaming_encoder_keeps_little():
    merges = bpe.codec_of(None).merges
    for text in ("abcdefgh" * 4000, "=" * 30_000, "ÃÂ" * 9000):
        encoder, raw, out, most = bpe.WordEncoder(merges), text.encode(), [], 0
        for k in range(0, len(raw), 100):
            out += encoder.feed(raw[k : k + 100])
            most = max(most, len(encoder.raw), len(encoder.last))
        out += encoder.finish()
        assert most <= encoder.due + 100
        assert b"".join(merges.bytes[t] for t in out) == raw
        whole = bpe.WordEncoder(merges)
        assert out == whole.feed(raw) + whole.finish()


def toy_merges(path, rng, n):
    """A vocabulary of three letters and n merges of tokens that stand before them in the list."""
    vocabulary, merges = list("abc"), []
    while len(merges) < n:
        a, b = rng.choice(vocabulary), rng.choice(vocabulary)
        if a + b not in vocabulary and len(a + b) <= 8:
            vocabulary.append(a + b)
            merges.append(f"{a} {b}")
    path.write_text(json.dumps({"model": {"vocab": {t: k for k, t in enumerate(vocabulary)}, "merges": merges}, "added_tokens": []}))
    return bpe.Merges(str(path))


def ends(merges, tokens):
    return set(np.cumsum([len(merges.bytes[t]) for t in tokens]).tolist())


def test_lookahead_is_sufficient(tmp_path):
    rng, tight = random.Random(12), 0
    for n in (1, 2, 4, 8, 16, 30, 60) * 6:
        merges = toy_merges(tmp_path / "toy.json", rng, n)
        for _ in range(40):
            raw = "".join(rng.choice("abc" if rng.random() < 0.5 else "ab") for _ in range(60)).encode()
            whole = merges.merged(raw)
            for end in range(1, len(raw)):
                before = ends(merges, merges.merged(raw[:end]))
                assert {e for e in before if end - e >= merges.lookahead} <= ends(merges, whole)
                tight += any(end - e == merges.lookahead - 1 for e in before - ends(merges, whole))
            encoder, out = bpe.WordEncoder(merges), []
            encoder.due = 1  # look for stable tokens after every byte
            for byte in raw:
                out += encoder.feed(bytes([byte]))
            assert out + encoder.finish() == whole
    assert tight  # one byte less would not do


def test_long_texts_are_streamed(spark, table, monkeypatch):
    texts = [t for _, t, *_ in table if t] + ["x<|endoftext|>" + "é" * 500 + " yes" * 90 + "<|endoftext|>", "<|endoftext|>"]
    codec = bpe.codec_of(None)
    whole = codec.encode_all(texts)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(bpe, "PIECE", 11)
    for text, raw in zip(texts, whole, strict=True):
        pieces = list(codec.pieces(text))
        assert b"".join(pieces) == raw
        assert max(map(len, pieces)) <= 4 * 7 * bpe.SHORT * 4
    monkeypatch.setattr(bpe, "TOGETHER", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    rows = [r for out in bpe._encode([batch], None, True) for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for r, raw, text in zip(rows, whole, texts, strict=True):
        assert (np.array(r["ids"], "<u4").tobytes(), r["n_tokens"], r["ids_sha256"]) == (raw, len(raw) // 4, hashlib.sha256(raw).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_personal_data(spark, docs, empty):
    rng, anchors = random.Random(6), pii.automaton()
    pieces = ["4", "1.2.3.4", "@", "a.b", "+", "49 123 456", "4111 1111 1111 1111", "4111111111111111", " ", "-", "..", "x@y.z", "999", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        found = pii.find(text, anchors)
        for kind, pattern in PATTERNS.items():
            want = []
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                want += [m.span()] * good
            assert found[kind] == want, (text, kind)
    more = pii.find('see https://a.example/x?y=1 IBAN: GB82 WEST 1234 5698 7654 32, token = "abc123def456"', anchors)
    assert [len(more[k]) for k in ("url", "iban", "account")] == [1, 1, 1]
    assert pii.find_personal_data(docs).count() == docs.count()
    assert pii.find_personal_data(empty).count() == 0
    hidden = pii.mask(spark.createDataFrame([(1, "write a.b@c.de now")], "doc_id long, text string")).first()["text"]
    assert hidden == "write <email> now"


def test_whole_secrets():
    """A long secret is found to its end, and a checked number although capitals follow."""
    anchors, secret = pii.automaton(), "a1" * 300
    assert pii.find(f"token: {secret} end", anchors)["account"] == [(7, 607)]
    for text in ("IBAN DE89370400440532013000 Please", "IBAN DE89 3704 0044 0532 0130 00 PLEASE CALL ME NOW AT 5", "IBAN DE89370400440532013000"):
        (a, b), = pii.find(text, anchors)["iban"]
        assert text[a:b].replace(" ", "") == "DE89370400440532013000"
    assert pii.find("IBAN DE88370400440532013000 Please", anchors)["iban"] == []


def test_cues_in_any_case():
    anchors = pii.automaton()
    for cue in ("token", "Token", "TOKEN", "toKeN"):
        assert pii.find(f"İ my {cue}: abcdef12345 end", anchors)["account"] == [(7 + len(cue), 18 + len(cue))]
    assert pii.find("see HtTpS://Example.org/x now", anchors)["url"] == [(4, 25)]


def test_null_ids(spark):
    """A null id is a value like any other: rows stay, nothing fails."""
    df = spark.createDataFrame([(None, "a b c d e f", "en", None, 0, 0, 0, 0), (None, None, None, None, 0, 0, 0, 0), (3, "a b c d e f", "en", "s", 0, 0, 0, 0)], SCHEMA)
    assert mixing.mix_sources(df).count() == 3
    assert exact_dedup.exact_duplicates(df).count() == 3
    assert exact_dedup.keep_one(df).count() == 2
    assert near_dedup.near_duplicates(df).count() == 3
    assert fingerprints.compare_with_next(df).count() == 3
    assert sharding.external_shuffle(df).count() == 3
    assert bpe.encode_documents(df).count() == 3
    assert pii.find_personal_data(df).count() == 3
    assert lm_scoring.score_documents(df, F.lit(True)).count() == 3
