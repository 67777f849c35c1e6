import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from locuskey.llm import langid
from locuskey.llm.queries import op2_quality_classifier, op4_packing, op7_sentencepiece
from test_dedup import roots, shingles

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0.3 * before < docs.count() <= before, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_extra_columns_and_nulls(spark):
    rows = [(1, "the cat sat on the mat", "en", None, 5, "s"), (2, None, None, "a", None, None), (None, "x", "en", "b", 1, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_last_stage_and_queries_carry_the_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    whole = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
    rows = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert sum(len(r.ids) for r in rows) == sum(map(len, whole.values()))
    for r in rows:
        assert list(r.ids) == whole[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for query in (op4_packing, op7_sentencepiece):
        out = query(spark, DATA)
        assert "ids#" in out._jdf.queryExecution().optimizedPlan().toString() and "ids" not in out.columns


def test_substring_stage_keeps_white_space(spark):
    twice = " ".join(f"w{i}" for i in range(40))
    texts = {1: " a\tb\r\n\nc  é ", 2: None, 3: f"Line 1\n\n{twice}\n  end\t", 4: twice, 5: ""}
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, docs, DATA).collect()}
    want = "Line 1\n\n\n  end\t"
    assert got == {1: (texts[1], len(texts[1])), 2: (None, None), 3: (want, len(want)), 4: ("", 0), 5: ("", 0)}


def without_repeats(texts, width=35):
    """Plain code: each text without the words, and what lies between them, of windows that begin anywhere else as well."""
    spots = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words = [[t[a:b] for a, b in s] for t, s in zip(texts, spots, strict=True)]
    counts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for t, s, w in zip(texts, spots, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        cut = "" if t is None else t
        for j in sorted(gone, reverse=True):
            cut = cut[: s[j][0]] + cut[s[j + 1][0] if j + 1 in gone else s[j][1] :]
        out.append(cut)
    return out


def test_run_against_plain_code(spark):
    """The models' decisions are the operators' own; all else is worked out here."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in op2_quality_classifier(spark, DATA).collect() if r.predicted}
    left = spark.createDataFrame([r for r in docs.collect() if r.doc_id in good], docs.schema)
    sure = {r.doc_id for r in langid.label(left, langid.fit(left)).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SURE}
    rows = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id in sure)
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    rows = [x for i, x in enumerate(rows) if roots(len(rows), links)[i] == i]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for (i, _), t in zip(rows, without_repeats([t for _, t in rows]), strict=True)}
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id][r.start] = list(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for start in sorted(p) for x in p[start]] for i, p in pieces.items()} == want
    assert links and len(good) < docs.count() and any(len(p) > 1 for p in pieces.values())
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
