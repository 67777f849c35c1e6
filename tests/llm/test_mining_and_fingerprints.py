import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from locuskey.llm import hard_negatives, piecewise_hash
from locuskey.llm.hard_negatives import mine
from locuskey.llm.importance_resampling import resample
from locuskey.llm.piecewise_hash import compare_with_next, likeness, likeness_of, with_fingerprints
from locuskey.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_importance_resampling"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and got


# Hard negatives.


def mined(rows, anchors, positives=5, negatives=10):
    """Plain code: rows are (id, label, vector) that take part, once each."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in rows)]
    width = max((len(v) for _, _, v in whole), default=0)
    whole = [(i, label, v + [0] * (width - len(v))) for i, label, v in whole]
    out = []
    for a, kind, v in whole:
        if not anchors(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, label) for i, label, w in whole if i != a]
        for s, i, _ in sorted(x for x in scores if x[2] == kind)[:positives]:
            fit = sorted(x for x in scores if x[2] != kind and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(a, i, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def clustered(seed, n=700, dim=12):
    r = np.random.RandomState(seed)
    centres = r.randn(9, dim)
    rows = [(i, int(r.randint(4)), (centres[r.randint(9)] + r.choice([0.05, 0.4]) * r.randn(dim)).round(3).tolist()) for i in range(n)]
    rows += [(1000 + i, int(r.randint(4)), rows[5][2]) for i in range(150)]  # copies of one vector: ties
    return rows


@pytest.mark.parametrize(("seed", "first", "block"), [(1, 16, 1024), (2, 1, 20)])
def test_mine(spark, monkeypatch, seed, first, block):
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "MORE", 1)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = clustered(seed)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    rows = [(i, label, [float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 25 == 0).collect()))
    assert got == mined(rows, lambda i: i % 25 == 0) and len(got) > 300


def test_mine_odd_rows(spark):
    """Nulls, values that are not finite, unequal lengths, repeated rows, one id with several vectors, other columns of any name."""
    r = random.Random(3)
    good = [(i, r.randrange(3), [r.choice([-1.5, 0.0, 0.25, 2.0]) for _ in range(r.randint(0, 4))]) for i in range(80)]
    good += [(7, 1, [9.0, 9.0]), (0, 2, [1.0])]
    bad = [(90, None, [1.0]), (91, 1, None), (92, 1, [1.0, None]), (93, 1, [float("nan")]), (94, 2, [float("inf")]), (None, 1, [1.0]), (95, 0, [1e300])]
    df = spark.createDataFrame([(*x, "a", 1) for x in good + good[:30] + bad], "vec_id long, label int, embedding array<double>, ids string, interval int")
    assert sorted(map(tuple, mine(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4).collect())) == mined(good, lambda i: i % 10 == 0, 3, 4)
    # Too long for doubles: 64-bit numbers.
    far = [(i, i % 2, [1e5 * (i + 1), 3e5 - i]) for i in range(30)]
    big = spark.createDataFrame(far, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, mine(big, F.col("vec_id") < 4).collect())) == mined(far, lambda i: i < 4)
    for none in (df.limit(0), df.where("label is null"), df.where("vec_id = 1")):
        assert mine(none, F.lit(True)).count() == 0
    assert mine(df, F.lit(False)).count() == 0


# Importance resampling.


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def features_of(t, n):
    w = words_of(t)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def drawn(docs, target, percent, least, n, buckets, seed):
    """Plain code: {row's place: (n_features, weight, score, rank)}."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x, n)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        f = features_of(x, n)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((p for p, (_, x) in enumerate(docs) if len(words_of(x)) >= least), key=lambda p: (-out[p][2], docs[p][0] is None, docs[p][0] or 0))
    for rank, p in enumerate(able[: percent * len(able) // 100], 1):
        out[p][3] = rank
    return out


def texts_of(seed, n):
    r = random.Random(seed)
    vocabulary = [*("".join(r.choice("abcdeXYZ09") for _ in range(r.randint(1, 5))) for _ in range(60)), "naïve", "日本", "É", "x_y", "a\x00b", "c\x7fd", "it's", "{q}"]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "-", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("percent", "n", "buckets"), [(25, 2, 10000), (60, 3, 50), (100, 1, 7)])
def test_resample(spark, percent, n, buckets):
    docs = list(enumerate(texts_of(1, 150))) + [(200, None), (201, ""), (202, "..."), (203, "word " * 30000), (None, "a b c d " * 9), (5, "again " * 25), (5, "again " * 25)]
    target = [*texts_of(2, 20), None]
    df = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, score string, _words int").repartition(3)
    got = resample(df, spark.createDataFrame([(x,) for x in target], "text string"), percent, 20, n, buckets)
    assert got.columns == ["doc_id", "_words", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    want = [(i, *x) for (i, _), x in zip(docs, drawn(docs, target, percent, 20, n, buckets, 7), strict=True)]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_resample_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert resample(none, docs).count() == 0
    assert sorted((r.doc_id, r.n_features, r.weight, r["rank"]) for r in resample(docs, none).collect()) == [(1, 3, math.floor(1000 * math.log(10003 / 20000)), None), (2, 0, 0, None)]


# Fingerprints.


def mixed(x):
    mask = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & mask
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def plain_fingerprint(text):
    """One byte after the other."""
    data, mask = (text or "").encode(), 2**64 - 1
    least = max(math.floor(math.log2(max(len(data), 1) / 64)) - 1, 0)
    hashes = [mixed((int.from_bytes(data[max(i - 7, 0) : i + 1].rjust(8, b"\0"), "little") + 0x9E3779B97F4A7C15) & mask) for i in range(len(data))]
    ends = lambda k: [i for i, h in enumerate(hashes) if h % 2**k == 0]
    k = next(k for k in range(least, 99) if len(ends(k)) < 64) if data else 0
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    signs = []
    for level in (k, k + 1, k + 2):
        cut = sorted({*ends(level), len(data) - 1}) if data else []
        symbols = [mixed(sum(hashes[a + 1 : b + 1]) & mask) >> 52 for a, b in zip([-1, *cut], cut, strict=False)]
        signs.append("".join(alphabet[x >> 6] + alphabet[x & 63] for x in symbols))
    return ":".join([str(k), *signs])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (k, *s), (j, *t) = a.split(":"), b.split(":")
    best = 0.0
    for x, n in zip(s, range(int(k), int(k) + 3), strict=True):
        for y, m in zip(t, range(int(j), int(j) + 3), strict=True):
            if n == m and x + y:
                p, q = ([z[i : i + 2] for i in range(0, len(z), 2)] for z in (x, y))
                row = list(range(len(q) + 1))
                for u in p:
                    last, row = row, [row[0] + 1]
                    for i, v in enumerate(q):
                        row.append(min(last[i] + 2 * (u != v), last[i + 1] + 1, row[-1] + 1))
                best = max(best, 1 - row[-1] / (len(p) + len(q)))
    return best


def odd_texts():
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh éß日") for _ in range(r.randint(1, 8))) for _ in range(n))
    base = prose(400)
    return ["", None, "a", "ab", "1234567", "12345678", "😀" * 40, "x" * 5000, "ab " * 900, *(prose(r.randint(1, 700)) for _ in range(25)), base, base, base[:900] + "NEW" + base[900:], base[:1000], "\0" * 300, prose(3)]


def test_fingerprints(spark, monkeypatch):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r.doc_id: r.fingerprint for r in with_fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert max(len(s) for f in got.values() for s in f.split(":")[1:]) <= 2 * piecewise_hash.PIECES
    # Neither the segments of bytes nor a text's neighbours matter.
    monkeypatch.setattr(piecewise_hash, "SEGMENT", 37)
    data = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    assert piecewise_hash.fingerprints_of(np.frombuffer(b"".join(data), np.uint8), offsets) == [got[i] for i in range(len(texts))]


def test_likeness(spark):
    prints = [plain_fingerprint(t) for t in odd_texts()]
    pairs = [(a, b) for a in prints for b in prints]
    got = likeness_of(*zip(*pairs, strict=True))
    assert all(abs(g - plain_likeness(a, b)) < 1e-12 for g, (a, b) in zip(got, pairs, strict=True)) and got.min() >= 0 and got.max() == 1
    df = spark.createDataFrame([(prints[-4], prints[-5]), (prints[0], prints[1]), (prints[0], prints[2]), (None, prints[0]), (None, None)], "a string, b string")
    near, same, apart, *nulls = [r[0] for r in df.select(likeness(F.col("a"), F.col("b"))).collect()]
    assert near > 0.85 and same == 1 and apart == 0 and nulls == [0, 0]


@pytest.mark.parametrize("block", [6 << 20, 500])
def test_compare_with_next(spark, block):
    texts = odd_texts()
    ids = random.Random(2).sample(range(10**6), len(texts))
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_chars int, _part string").repartition(4)
    got = {r.doc_id: r for r in compare_with_next(df, keep_edited=True, block_bytes=block).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(got) == len(order)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = t or "", u or "", got[i]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_text, r.edited_sha256, r["_part"]) == (len(t), edited, hashlib.sha256(edited.encode()).hexdigest(), "r")
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(t), plain_fingerprint(edited))
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12 and abs(r.near_next - plain_likeness(r.fingerprint, plain_fingerprint(u))) < 1e-12


def test_compare_with_next_odd_tables(spark):
    schema = "doc_id long, text string"
    assert compare_with_next(spark.createDataFrame([], schema)).count() == 0
    (one,) = compare_with_next(spark.createDataFrame([(1, "abcdef")], schema)).collect()
    assert (one.n_chars, one.near_next) == (6, 1) and one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    rows = [(None, "z"), (2, "same"), (2, "same"), (2, "same"), (1, None)]
    got = compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.near_next) for r in got) == [(0, 1, 0), (1, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 1)]


def test_fingerprints_tell_edits_from_others(spark):
    got = QUERIES["op13_piecewise_hash"](spark, DATA).where("n_chars >= 200").toPandas()
    assert got.near_edited.median() > 0.45 and got.near_next.median() < 0.05 and (got.near_edited > got.near_next).mean() > 0.95
