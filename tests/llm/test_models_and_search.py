import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from locuskey.llm import bm25, langid, quality

DATA = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "held_out", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (4, "w " * 100_000, "d"), (4, "!!! @@@", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.score(df, quality.fit(df, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(df.limit(0), quality.fit(df.limit(0), labels)).count() == 0


def test_nnpu_risk_turns_back():
    r = np.random.RandomState(0)
    good, bad = r.standard_normal((300, quality.N_FEATURES)) + 1, r.standard_normal((300, quality.N_FEATURES)) - 1
    model = quality.fit_nnpu(good[:150], np.concatenate([good[150:], bad[:150]]), 0.5)
    assert (model.score(good) > 0.5).mean() > 0.97 and (model.score(bad[150:]) < 0.5).mean() > 0.97


def test_prior_from_biased_labels(spark):
    """Labels nearly all positive: the prior is still that of the texts."""
    r = np.random.RandomState(1)
    good, bad = r.standard_normal((1600, quality.N_FEATURES)) + 0.5, r.standard_normal((1600, quality.N_FEATURES)) - 0.5
    for share in (0.2, 0.5, 0.8):
        n = int(share * 1000)
        assert abs(quality.estimate_prior(good[:600], np.concatenate([good[600 : 600 + n], bad[: 1000 - n]])) - share) < 0.1
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    biased = labels.where("quality = 1 or doc_id % 10 = 0")
    rows = quality.score(docs, quality.fit(docs, biased)).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([x.predicted == x.quality for x in rows]) > 0.95


def test_repeated_rows_are_scored_alike(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 200")
    twice = docs.unionByName(docs).withColumn("a.b", docs.doc_id).withColumn("lang_pred", docs.doc_id)
    for out in (quality.score(twice, quality.fit(twice, spark.read.parquet(f"{DATA}/labels.parquet"))), langid.label(twice, langid.fit(twice))):
        rows = out.groupBy("doc_id").agg({"*": "count"}).collect()
        assert "a.b" in out.columns and all(r["count(1)"] % 2 == 0 for r in rows)
        assert out.select("doc_id", "score").distinct().count() == docs.select("doc_id").distinct().count()


def test_letters_of_every_plane():
    model = langid.Model(["x", "y"], np.ones((langid.BUCKETS, 2)), np.zeros(2), 1.0)
    texts = ["\U00030000\U000313ff", "\U0001f600", "\u6771"]
    assert [t == "und" for t in langid.predict(model, *langid.text_buffers(pa.array(texts)))[0]] == [False, True, False]


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.label(docs, langid.fit(docs)).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    rows = [(1, None, "en"), (2, "123 !!", "en"), (3, "the cat", None), (None, "le chat", "fr"), (5, "the dog", "en"), (6, "le chien", "fr"), (8, "z" * 200_000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.label(df.withColumn("score", df.doc_id), langid.fit(df)).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].lang_pred, by[2].lang_pred, by[2].score) == ("und", "und", 0.0) and len(got) == 7
    assert {r.lang_pred for r in langid.label(df, langid.fit(df.limit(0))).collect()} == {"und"}


def test_ftrl_l1_keeps_weights_at_zero():
    m = langid.Ftrl(4, 2, l1=5.0)
    m.learn(np.array([0]), np.array([1.0]), 1)
    assert not m.weights().any()


def test_predict_does_not_depend_on_chunks():
    r = random.Random(1)
    texts = ["".join(r.choice("abcé d\n1") for _ in range(r.randint(0, 60))) for _ in range(50)]
    model = langid.Model(["x", "y"], np.random.RandomState(1).standard_normal((langid.BUCKETS, 2)), np.zeros(2), 1.0)
    together = langid.predict(model, *langid.text_buffers(pa.array(texts)))
    alone = [langid.predict(model, *langid.text_buffers(pa.array([t]))) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])


def test_search_is_exact(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(150)]
    texts = [" ".join(vocabulary[int(r.paretovariate(0.6)) % 150] for _ in range(r.randint(1, 80))) for _ in range(240)]
    texts += [texts[0], texts[0].upper(), "", None, "lonely"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.query_id, x.rank): (x.doc_id, x.score) for x in bm25.search(df, df.where("doc_id % 20 = 0 or doc_id > 238"), k=7, shard_bytes=3000).collect()}
    w = [Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t in texts]
    mean = sum(sum(c.values()) for c in w) / len(w)
    df_ = Counter(t for c in w for t in c)
    idf = {t: math.log(1 + (len(w) - n + 0.5) / (n + 0.5)) for t, n in df_.items()}
    want = {}
    for q in range(len(texts)):
        if q % 20 == 0 or q > 238:
            scores = []
            for i, c in enumerate(w):
                s = sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in w[q] if t in c)
                if s > 0:
                    scores.append((-round(s, 8), i))
            want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:7])}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert bm25.search(df.limit(0), df, k=3).count() == 0 and bm25.search(df, df.limit(0), k=3).count() == 0
    one = spark.createDataFrame([(7, "a b", 1), (8, "c " * 40_000, 1), (9, None, 1), (9, None, 1)], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(7, "a"), (7, "c"), (7, "c"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert sorted((x.query_id or 0, x.doc_id, x.rank) for x in bm25.search(one, asked, k=1).collect()) == [(0, 7, 1), (0, 8, 1), (7, 7, 1), (7, 8, 1)]
    assert bm25.search(one.union(one), asked.limit(1), k=9).count() == 2
