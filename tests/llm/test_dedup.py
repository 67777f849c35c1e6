import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from locuskey.llm.components import components
from locuskey.llm.embedding_dedup import near_vectors
from locuskey.llm.jaccard_join import one_of_each, similar_documents
from locuskey.llm.scratch import Tables
from locuskey.llm.substring_dedup import remove_repeated_windows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def family(seed, groups=12, size=25):
    """Groups of near copies whose similarities lie round the threshold, shared passages, odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([6, 40, 90]))] + passage[: r.choice([0, 30, 60])]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    turn = [bin(i).count("1") % 2 for i in range(2048)]
    alike = ["".join(pair[x] for x in turn) for pair in ("ab", "ba")]
    long_ = " ".join(word() for _ in range(9000))
    texts += [" ".join([*"vwxyz", x]) for x in alike] + [long_, long_ + " more", long_[: len(long_) // 2]]
    return [*texts, texts[0], texts[0].upper(), "", None, "one two", "One  two", " \t\n", "é è"]


@pytest.mark.parametrize(("seed", "leaf", "depth"), [(1, 128, 4), (2, 2, 3), (3, 4, 0)])
def test_similar_documents(spark, seed, leaf, depth):
    texts = family(seed)
    sets = [shingles(t) for t in texts]
    n = len(texts)
    links = [(i, j) for i in range(n) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(n, links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(df, leaf=leaf, depth=depth).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(n)}


def test_one_of_each(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "p q r s t u", "z"), (3, None, "n"), (4, "", "e"), (None, "v w x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `class` string")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r["class"] or "") for r in got.collect()) == [(0, ""), (0, "z"), (1, "x"), (3, "n"), (4, "e")]
    assert one_of_each(df.limit(0)).count() == 0 and similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1 << 18, 20])
def test_components(spark, few):
    """A chain of ordered names is as good as any graph, with rounds or in one task."""
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 490)]
    want = roots(500, links)
    got = components(spark.createDataFrame(links, "a long, b long"), Tables(spark), few).collect()
    by = defaultdict(set)
    for x in got:
        by[x.root].add(x.node)
    groups = defaultdict(set)
    for i, x in enumerate(want):
        groups[x].add(i)
    assert sorted(map(sorted, by.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def expected_windows(texts, width):
    every = [words(t) for t in texts]
    counts = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for w in every:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if counts[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_windows(spark):
    texts = family(7, 6, 4) + ["x " * 50, "y y y y y y", "é\x0bé  ü\n" * 3, "q" * 3_000_000 + " tail"]
    want = expected_windows(texts, 5)
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, `_block` int")
    out = remove_repeated_windows(df, width=5)
    assert out.columns.count("n_words") == 1 and "_block" in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert [(rows[i].n_words, rows[i].n_removed, rows[i].kept_text, rows[i].kept_sha256) for i in range(len(texts))] == want
    assert all(sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in rows.values())
    assert remove_repeated_windows(df.limit(0)).count() == 0


def test_near_vectors(spark):
    r = np.random.RandomState(2)
    centers = r.standard_normal((20, 32))
    v = np.concatenate([c + s * r.standard_normal((15, 32)) for c, s in zip(centers, r.uniform(0.02, 0.3, 20), strict=True)])
    v = np.concatenate([v, v[:5], v[:3] * 7])
    unit = v / np.sqrt((v * v).sum(1))[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(len(v), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, [None] * 32), (1004, []), (1005, [1e300] + [0.0] * 31), (1006, [1.0] * 3), (1007, [2.0] * 3)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + odd, "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in near_vectors(df, recall=0.9999, tile=16).collect()}
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(len(v)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1006))
    assert got[1007].component_id == 1006 and got[1006].n_links == 1
    assert near_vectors(df.limit(0)).count() == 0


def test_windows_in_thue_morse_order(spark):
    """Two words in Thue-Morse order and with the words changed over: polynomials modulo a power of two can't tell them apart."""
    turn = [bin(i).count("1") % 2 for i in range(32)]
    texts = [" ".join([*"pqr", *(pair[x] for x in turn)]) for pair in (("zxugna", "mwyygb"), ("mwyygb", "zxugna"))]
    got = remove_repeated_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r.n_words, r.n_removed, r.kept_text) for r in got.orderBy("doc_id").collect()] == [(35, 0, t) for t in texts]
    twice = remove_repeated_windows(spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[0])], "doc_id long, text string"))
    assert [r.n_removed for r in twice.orderBy("doc_id").collect()] == [35, 0, 35]


def test_near_vectors_recall_at_its_default(spark):
    """Pairs just above the threshold, where most are missed; no link is made up."""
    r = np.random.RandomState(9)
    one = r.standard_normal((1500, 48))
    one /= np.sqrt((one * one).sum(1))[:, None]
    other = r.standard_normal(one.shape)
    other -= (other * one).sum(1)[:, None] * one
    other /= np.sqrt((other * other).sum(1))[:, None]
    two = 0.9502 * one + np.sqrt(1 - 0.9502**2) * other
    v = np.concatenate([one, two])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in near_vectors(df, cosine=0.95).collect()}
    cosine = v @ v.T
    linked = [i for i in range(1500) if got[i].n_links]
    assert len(linked) >= 0.97 * 1500
    for i in linked:
        near = np.flatnonzero(cosine[i] >= 0.95)
        assert got[i].n_links <= len(near) - 1 and got[1500 + i].component_id == got[i].component_id
    assert all(got[i].component_id in np.flatnonzero(cosine[i] >= 0.95) or got[i].n_links > 1 for i in linked)
