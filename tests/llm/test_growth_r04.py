"""Findings of round 4 on training-data operators: what grows with the input stays in tasks."""

import numpy as np
from pyspark.sql import functions as F

from locuskey.llm import hard_negatives


def test_rounds_of_mining_are_no_jobs(spark, monkeypatch):
    """A round more writes no table and sends no pack to a block; ranges are sampled without vectors."""
    written, dealt = [], []
    write, frame = hard_negatives.Tables.write, type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(hard_negatives.Tables, "write", lambda self, df, name, *a, **b: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df, name, *a, **b))
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: dealt.append(cols) or deal(self, n, *cols))
    monkeypatch.setattr(hard_negatives, "FIRST", 1)
    monkeypatch.setattr(hard_negatives, "MORE", 1)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    r = np.random.RandomState(6)
    rows = [(i, int(r.randint(3)), r.randn(6).round(3).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    found = hard_negatives.mine(df, F.col("vec_id") % 20 == 0)
    assert found.select("anchor_id").distinct().count() > 20
    assert len(written) == 3 and not any("Join" in plan for plan in written)
    assert dealt and all("x" not in cols for cols in dealt)


def test_copies_are_searched_once(spark, monkeypatch):
    """Copies of texts and queries, repeated rows, null ids and texts, against plain code; a text is indexed and asked once."""
    import math
    import random
    from collections import Counter

    from locuskey.llm import bm25

    r = random.Random(8)
    texts = [" ".join(f"w{int(r.paretovariate(0.8)) % 70}" for _ in range(r.randint(1, 30))) for _ in range(60)]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(None, texts[0]), (3, texts[1]), (3, texts[1]), (400, None), (401, ""), (402, texts[2].upper())] + [(500 + i, texts[5]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written = {}
    write = bm25.Tables.write
    monkeypatch.setattr(bm25.Tables, "write", lambda self, df, name, *a, **b: written.setdefault(name, write(self, df, name, *a, **b)))
    asked = df.where("doc_id % 4 = 0 or doc_id is null")
    got = {tuple(x) for x in bm25.search(df, asked, k=7).collect()}
    n_texts = len({(t or "").lower() for _, t in rows})
    assert written["index"].selectExpr("sum(size(_ids))").first()[0] == n_texts
    assert written["packs"].selectExpr("sum(size(_ids))").first()[0] <= n_texts + 2
    split = [(i, (t or "").lower().split()) for i, t in rows]
    n, mean = len(split), sum(len(t) for _, t in split) / len(split)
    df_of = Counter(w for _, t in split for w in set(t))
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df_of.items()}
    score = lambda q, t: sum(idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w, c in Counter(t).items() if w in q)
    want = set()
    for q, t in {(i, (t or "").lower()) for i, t in rows if i is None or i % 4 == 0}:
        every = sorted(((-round(s, 6), i is None, i or 0) for i, u in split if (s := score(set(t.split()), u)) > 0))
        want |= {(q, None if none else i, -s, rank) for rank, (s, none, i) in enumerate(every[:7], 1)}
    assert {(q, i, round(s, 6), n) for q, i, s, n in got} == want and len(want) > 500
