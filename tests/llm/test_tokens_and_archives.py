import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locuskey.llm import sentencepiece_lattice as lattice
from locuskey.llm import warc
from locuskey.llm.packing import FirstFit, WordIds, pack
from locuskey.llm.queries import op5_sharding
from locuskey.llm.sharding import SLOTS, lookup_table, place, write_shards
from locuskey.llm.textkernel import Words, squeeze

_turn = [bin(i).count("1") % 2 for i in range(2048)]
#: Two words that a polynomial hash modulo a power of two makes equal, whatever its base.
_THUE = ["".join("ab"[x] for x in _turn), "".join("ba"[x] for x in _turn)]
TEXTS = ["", None, " ", "a  b", "Hello, World's <|endoftext|> 12 é É ﬁ", "日本語 text\x0bwith\x1codd spaces", "x" * 5000, "word " * 9000, "\n\n;\r\n", "a▁b", "😀 ok", "<s> hi", *_THUE]


def test_pack(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(1)
    texts = TEXTS + [" ".join("".join(r.choice("abcdeé.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, "", 1)], "doc_id long, text string, `length` int")
    rows = pack(df, path, group_pieces=40).collect()
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        assert list(x.ids) == whole[x.doc_id][x.start : x.start + x.length] and x.doc_tokens == len(whole[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        docs[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
    assert len(docs[0]) == 2
    for i in range(1, len(texts)):
        at = 0
        for s, n in sorted(docs[i]):
            assert s == at
            at += n
        assert at == len(whole[i])
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert pack(df.limit(0), path).count() == 0


def test_short_ways_of_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    words, tokenizer = WordIds(path), Tokenizer.from_file(path)
    assert words.short
    r = random.Random(3)
    parts = ["a", "B", "xyz", "é", "É", "\u0301", "\u0338", "'", "'s", "'LL", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", ".", ",!", "=", "1", "٣", "İ", "Σ", "ς", "東", "\u3000", "\x1c", "\x85", " ", "\n", "-", "_", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20_000)] + ["don't. can't.. it's! IT'S. a'.s x='t", "." * 99, "a" + "." * 99]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    cut = Words(np.frombuffer(data, np.uint8), offsets, marks=words.marks)
    ids, begins = words.ids(cut)
    edges = begins[cut.first]
    for i, whole in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[edges[i] : edges[i + 1]].tolist() == whole.ids, texts[i]


def test_first_fit():
    r = random.Random(2)
    bins, slow = FirstFit(100), []
    for _ in range(500):
        n = r.randint(1, 100)
        spot = next((i for i, x in enumerate(slow) if x + n <= 100), len(slow))
        if spot == len(slow):
            slow.append(0)
        assert bins.place(n) == (spot, slow[spot])
        slow[spot] += n
    assert bins.used == len(slow)


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = lookup_table(names)
    sizes = np.bincount(table)
    assert len(table) == SLOTS and sizes.max() - sizes.min() <= 1
    fewer = lookup_table(names[:-1])
    assert np.mean((table != fewer) & (table != 6)) < 0.1
    with pytest.raises(ValueError):
        lookup_table(["a", "a"])
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "doc_id long, slot string")
    rows = place(df, names).collect()
    assert len(rows) == 3 and rows[0].shard == rows[1].shard and all(names[table[x.slot]] == x.shard for x in rows)
    assert place(df.limit(0), names).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ é", "<p>x\r\n\r\ny</p>"), (2, None, "<p>x\r\n\r\ny</p>"), (3, "u\r\nInjected: 1", "é" * 70_000), (4, "u", None), (5, "u", ""), (None, "n", ""), (None, "n", "alone"), (5, "again", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    records = warc.read_archives(index)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve_revisits(records).collect()), key=str)
    want = [(1, 13, "revisit", 2), (2, 13, "response", None), (3, 140_000, "response", None), (4, 0, "revisit", 5), (5, 0, "response", None), (5, 0, "response", None), (0, 0, "revisit", 5), (0, 5, "response", None)]
    assert got == sorted(want, key=str)
    assert {r.payload for r in records.where("page_id = 3").collect()} == {"é" * 70_000}
    some = warc.read_archives(index.where("page_id = 2")).collect()
    assert [r.payload for r in some] == ["<p>x\r\n\r\ny</p>"]
    assert warc.read_archives(warc.write_archives(df.limit(0), f"file://{tmp_path}/e")).count() == 0
    every = warc.resolve_revisits(warc.read_archives(warc.write_archives(df, f"file://{tmp_path}/m", min_bytes=10)))
    assert sorted(r.page_id for r in every.where("record_type = 'revisit'").collect()) == [1]


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    texts = TEXTS + ["aaa" * 40, ";\r a;\r\n", " lead"] + ["".join(r.choice("abcehinorst  .,;é\n'") for _ in range(200)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lattice.encode(df, path)
    got = {x.doc_id: x for x in rows.collect()}
    assert all(list(got[i].ids) == library.encode(t or "") for i, t in enumerate(texts))
    decoded = {x.doc_id: x.text for x in lattice.decode(rows, path).collect()}
    plain = [i for i, t in enumerate(texts) if "▁" not in (t or "")]
    assert all(decoded[i] == (texts[i] or "") and got[i].round_trip for i in plain)
    assert lattice.encode(df.limit(0), path).count() == 0


def _merged(v, s):
    """BPE as it is defined: the best-scored neighbours are joined, the first of equals, until none are a piece."""
    parts = list(s)
    while True:
        found = [(-v.pieces[a + b][1], j) for j, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.pieces]
        if not found:
            return [i for x in parts for i in ([v.pieces[x][0]] if x in v.pieces else v.fallback(x))]
        j = min(found)[1]
        parts[j : j + 2] = [parts[j] + parts[j + 1]]


def _best_path(v, s):
    worst = min(x for _, x in v.pieces.values()) - 10.0
    best = [(0.0, [])] + [(-np.inf, [])] * len(s)
    for k in range(1, len(s) + 1):
        for i in range(k):
            found = v.pieces.get(s[i:k])
            if found or k - i == 1:
                score = best[i][0] + (found[1] if found else worst)
                if score > best[k][0]:
                    best[k] = (score, best[i][1] + ([found[0]] if found else v.fallback(s[i:k])))
    return best[-1][1]


def test_folds_against_plain_code(spark):
    r = random.Random(4)
    segments = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 14))) for _ in range(120)} | {"".join(r.choice("abc") for _ in range(n)) for n in (61, 62, 63, 90)})
    for bpe, ties in ((True, False), (True, True), (False, False)):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)} | {"a", "b"})
        scores = [r.randint(1, 9) if ties else x for x in r.sample(range(1, 1000), len(words))]
        v = lattice.Vocabulary({w: (300 + i, -float(s)) for i, (w, s) in enumerate(zip(words, scores, strict=True))}, tuple(range(256)), bpe)
        df = spark.createDataFrame([(len(s), s) for s in segments], "_range long, segment string")
        got = {x.segment: list(x.ids) for x in lattice.encode_segments(df, v).collect()}
        assert got == {s: (_merged if bpe else _best_path)(v, s) for s in segments}


def test_lost_segments_are_errors():
    import pyarrow as pa

    asked = pa.table({"_range": [0], "_block": [0], "_segments": [squeeze([b"ab", b"c"])]})
    encoded = pa.table({"_range": [0], "segment": ["ab"], "ids": pa.array([[1]], pa.list_(pa.int32()))})
    with pytest.raises(KeyError):
        lattice._answer()(None, asked, encoded)


def test_lattice_has_no_second_shuffle(spark):
    v = lattice.Vocabulary({"a": (0, -1.0), "ab": (1, -2.0)}, (), True)
    df = spark.createDataFrame([(0, "ab")], "_range long, segment string").repartition(4, "_range")
    plan = lattice.encode_segments(df, v)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i % 90 if i % 10 else None, f"text {i}\n") for i in range(400)], "doc_id long, text string")
    names = [f"s{i}" for i in range(7)]
    placed = place(df, names)
    write_shards(placed, str(tmp_path / "out"), file_rows=20)
    back = spark.read.schema(placed.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, placed.collect()))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} <= {f"shard={n}" for n in names}
    data = "/root/testdata/sf0.001"
    out = op5_sharding(spark, data)
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0]))
    whole = spark.read.parquet(f"{data}/documents.parquet")
    assert spark.read.parquet(folder).select(whole.columns).exceptAll(whole).count() == 0
    assert out.columns == ["doc_id", "slot", "shard"] and out.count() == whole.count()
