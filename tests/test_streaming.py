"""Cases that are scored again as their texts arrive."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.streaming import rescore
from riskspark.streaming.rescore import ARRIVAL, CaseStore

POSTS = 40


def score(spark, seen):
    """Stands for the scoring: how many texts a case has, and all of them in order; notes which cases it was asked for."""

    def run(texts, touched):
        seen.append(sorted(r["case_id"] for r in touched.collect()))
        own = texts.groupBy("case_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "no", "text"))), "|").alias("all"))
        return spark.range(POSTS).select(F.col("id").alias("case_id")).join(touched, "case_id").join(own, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("all", F.lit("")).alias("all"))

    return run


def arrivals(seed=1):
    """Four batches; texts are corrected later, some cases are unknown, ids and texts null."""
    rng, out = np.random.default_rng(seed), []
    for batch in range(4):
        rows = [(int(rng.integers(0, POSTS + 3)), ("speech", "frame")[rng.integers(2)], int(rng.integers(0, 3)), 1.0, f"t{batch}.{k}", batch * 100 + k) for k in range(12)]
        out.append([*rows, (None, "speech", 0, 1.0, "x", 0), (3, "frame", 9, None, None, batch)])
    return out


def whole(batches):
    last = {}
    for case, kind, no, _, text, sent in sorted((r for b in batches for r in b if r[0] is not None), key=lambda r: r[5]):
        last[case, kind, no] = text
    out = {}
    for case in range(POSTS):
        own = sorted(":".join(x for x in (kind, str(no), text) if x is not None) for (c, kind, no), text in last.items() if c == case)
        out[case] = (len(own), "|".join(own))
    return out


def table(store):
    return {r["case_id"]: (r["n"], r["all"]) for r in store.cases.collect()}


def test_stream_equals_a_full_batch(spark, tmp_path):
    seen = []
    store = CaseStore(spark, f"{tmp_path}/store", score(spark, seen), buckets=5)
    store.fill(spark.range(POSTS).select(F.col("id").alias("case_id")))
    assert table(store) == dict.fromkeys(range(POSTS), (0, ""))
    for k, rows in enumerate(arrivals()):
        spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen.clear()
    store.follow(spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/progress").awaitTermination()
    assert table(store) == whole(arrivals())
    asked = [s for s in seen if s]
    assert len(asked) == 4 and all(len(s) <= 13 for s in asked)  # only the cases of a batch
    # Nothing new, nothing done.
    seen.clear()
    store.follow(spark.readStream.schema(ARRIVAL).parquet(f"{tmp_path}/in"), f"{tmp_path}/progress").awaitTermination()
    assert not [s for s in seen if s] and table(store) == whole(arrivals())


def test_batches_lost_and_sent_again(spark, tmp_path, monkeypatch):
    """A batch that dies between its two writes, is sent again, and again once later ones are in."""
    batches = [spark.createDataFrame(rows, ARRIVAL) for rows in arrivals(2)]
    store = CaseStore(spark, f"{tmp_path}/store", score(spark, []), buckets=3)
    store.fill(spark.range(POSTS).select(F.col("id").alias("case_id")))
    store.take(batches[0])
    with monkeypatch.context() as m:
        m.setattr(rescore.CaseStore, "fill", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.take(batches[1])
    store.take(batches[1])
    store.take(batches[2])
    store.take(batches[1])
    store.take(batches[3])
    store.take(batches[0])
    assert table(store) == whole(arrivals(2))
