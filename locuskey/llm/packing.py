"""Packing: token ids of documents into fixed-length sequences, first-fit decreasing inside random groups.

A document's ids are cut into pieces of ``length`` and a rest. Pieces are dealt at random into groups
of bounded size; each group is packed on its own: pieces in falling length go to the first sequence
with room, found in a tournament tree of the sequences' free room.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskey.llm.scratch import Tables, send_package
from locuskey.llm.textkernel import Words, chunks, distinct_runs, give_back, text_buffers

#: Pieces in a group, about.
GROUP_PIECES = 4096
#: Words whose ids a worker remembers; then it starts afresh.
REMEMBERED = 3 << 18
#: Bytes of text that are cut into words at once: more of them repeat in more.
CHUNK_BYTES = 3 << 20
# The pattern that cuts text into what the model sees, and the normalizers beside it, for which the short ways of WordIds hold.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Marks that may be cut off a word's end: ASCII, but for the apostrophe and what special tokens are written with.
_MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: Words of ASCII letters and of those of U+00C0 to U+00FF.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: How ByteLevel writes the bytes of such letters that are no printing characters in Latin-1.
_BYTES = {128 + i: 290 + i for i in range(33)} | {173: 323}
_PROBE = ["Aa", "b1", "c.", "Ünï", "東京", "x_y"]


class WordIds:
    """Token ids of white-space separated words, each different word encoded once.

    Only for tokenizers whose result over a text is the results over its words joined, such as those
    that drop white space; others are refused. Words count as the same if their bytes are.

    Where the tokenizer lower-cases and cuts letters from marks by the one pattern known here, two short ways give
    the same ids: marks at a word's end are a word of their own, and words of the letters A to Z and U+00C0 to
    U+00FF alone, which no normalizer but the lower case changes, go in lower case straight to the model.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        apart = [i for x in self._encode(_PROBE) for i in x]
        if any(x != apart for x in self._encode([gap.join(_PROBE) for gap in (" ", "\t", "\n  ")])):
            raise ValueError(f"{path}: white space changes the ids of words")
        self.short = self._knows_cuts(json.loads(self.tokenizer.to_str()))
        self.marks = None
        if self.short:
            self.marks = np.zeros(256, bool)
            self.marks[list(_MARKS)] = True
        self._clear()

    @staticmethod
    def _knows_cuts(spec: dict) -> bool:
        """Whether the short ways hold: by the normalizers, the pattern and what special tokens look like."""
        steps = lambda x, many: (x.get(many) or [x]) if x else []
        normalizers, cuts = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        special = [t["content"].encode() for t in spec["added_tokens"]]
        return (
            [x["type"] for x in normalizers] == _NORMALIZERS
            and normalizers[1]["pattern"] == {"Regex": r"\s+"}
            and normalizers[1]["content"] == " "
            and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _CUTS}
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and spec["model"]["type"] == "BPE"
            and not spec["model"]["dropout"]
            and not any(not t.isascii() or t.isalpha() or re.search(rb"[A-Za-z][" + re.escape(_MARKS) + rb"]", t) for t in special)
        )

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        if not self.short:
            return self._encode([w.decode("utf-8", "replace") for w in words])
        model = self.tokenizer.model
        plain = [w.lower().decode() if w.isalpha() else w.decode().lower().encode().decode("latin-1").translate(_BYTES) if _LETTERS.fullmatch(w) else None for w in words]
        others = iter(self._encode([w.decode("utf-8", "replace") for w, t in zip(words, plain, strict=True) if t is None]))
        return [[x.id for x in model.tokenize(t)] if t is not None else next(others) for t in plain]

    def _clear(self):
        self.n = 0
        # Of each known word: where its ids and its bytes begin. The hashes in order point to words.
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.text_at, self.text = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.hashes, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _append(ends: np.ndarray, values: np.ndarray, n: int, sizes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``values`` behind the first ``n``; the arrays grow by doubling."""
        grow = lambda x, size: x if size <= len(x) else np.concatenate([x, np.zeros(size, x.dtype)])
        used = int(ends[n])
        ends, values = grow(ends, n + 1 + len(sizes)), grow(values, used + len(more))
        ends[n + 1 : n + 1 + len(sizes)] = used + np.cumsum(sizes)
        values[used : used + len(more)] = more
        return ends, values

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the known word that each word is or -1, which hashes are known): by hash, and the bytes are compared."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit, word, size = self.hashes[at] == hashes, self.word[at], ends - starts
        same = hit & (size == self.text_at[word + 1] - self.text_at[word])
        rows = np.flatnonzero(same)
        for a, b in chunks(np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(size[rows])])):
            part, count = rows[a:b], size[rows[a:b]]
            spot = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            differ = data[np.repeat(starts[part], count) + spot] != self.text[np.repeat(self.text_at[word[part]], count) + spot]
            if differ.any():
                same[np.repeat(part, count)[differ]] = False
        return np.where(same, word, -1), hit

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, known: np.ndarray):
        """New words; those whose hash is another word's have ids but are not found again."""
        raw = data.tobytes()
        texts = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = self._encode_words(texts)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin, self.flat = self._append(self.begin, self.flat, self.n, counts, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())))
        self.text_at, self.text = self._append(self.text_at, self.text, self.n, ends - starts, np.frombuffer(b"".join(texts), np.uint8))
        fresh = np.flatnonzero(~known)
        values, first = np.unique(hashes[fresh], return_index=True)
        spot = np.searchsorted(self.hashes, values)
        self.hashes, self.word = np.insert(self.hashes, spot, values), np.insert(self.word, spot, self.n + fresh[first])
        self.n += len(texts)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's begin (one entry more)."""
        if not len(words.hashes):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        sample, which = distinct_runs(words.bytes, words.starts, words.ends, words.hashes)
        if self.n > self.remembered:
            self._clear()
        starts, ends, hashes = words.starts[sample], words.ends[sample], words.hashes[sample]
        found, known = self._find(words.bytes, starts, ends, hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self.n + np.arange(len(new))
            self._learn(words.bytes, starts[new], ends[new], hashes[new], known[new])
        at = found[which]
        begin = self.begin[at]
        count = self.begin[at + 1] - begin
        ends = np.cumsum(count)
        take = np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]))
        return self.flat[take], np.concatenate([[0], ends])


_encoders: dict[tuple[str, int], WordIds] = {}


def _pieces(path: str, end_id: int, length: int, remembered: int = REMEMBERED, chunk_bytes: int = CHUNK_BYTES):
    def run(batches):
        encoder = _encoders.get((path, remembered))
        if encoder is None:
            encoder = _encoders[path, remembered] = WordIds(path, remembered)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(data, offsets, chunk_bytes):
                words = Words(data, offsets[a : b + 1], marks=encoder.marks)
                ids, begins = encoder.ids(words)
                edges = begins[words.first]
                rows, starts, lengths, sums, totals, parts = [], [], [], [], [], [np.zeros(0, "<u4")]
                for r in range(b - a):
                    own = np.append(ids[edges[r] : edges[r + 1]], np.int32(end_id)).astype("<u4")
                    parts.append(own)
                    for s in range(0, len(own), length):
                        piece = own[s : s + length]
                        rows.append(a + r)
                        starts.append(s)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(own))
                ends = np.cumsum([0, *lengths]).astype(np.int32)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sums, totals))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "start", "_sum", "doc_tokens", "ids"])
            give_back()

    return run


class FirstFit:
    """Places items into bins of one capacity, always into the first bin with room; a tournament tree has the largest room below each node."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.used = capacity, 1, 0
        self.room = [0, capacity]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        room = self.room
        if room[1] < size:
            self._double()
            room = self.room
        node = 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        spot = node - self.leaves
        self.used = max(self.used, spot + 1)
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
        return spot, offset

    def _double(self):
        old = self.room[self.leaves :]
        self.leaves *= 2
        leaves = old + [self.capacity] * (self.leaves - len(old))
        level, levels = leaves, [leaves]
        while len(level) > 1:
            level = [max(level[i], level[i + 1]) for i in range(0, len(level), 2)]
            levels.append(level)
        self.room = [0] + [x for level in reversed(levels) for x in level]


def _pack_group(length: int):
    def run(key, table):
        table = table.combine_chunks()
        pieces = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in table.column("ids").chunks]
        sizes = np.concatenate([np.diff(offsets) for _, offsets in pieces]).astype(np.int64)
        sums = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for ids, offsets in pieces for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        order = np.lexsort((np.asarray(table.column("start").combine_chunks()), np.asarray(table.column("_tie").combine_chunks()), -sizes))
        bins = FirstFit(length)
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for i in order:
            sequence[i], offset[i] = bins.place(int(sizes[i]))
        return pa.table(
            {
                "_id": table.column("_id"),
                "start": table.column("start"),
                "length": pa.array(sizes),
                "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": table.column("doc_tokens"),
                "ids": table.column("ids"),
                "sequence_id": pa.array((key[0].as_py() << 32) + sequence),
                "offset": pa.array(offset),
            }
        )

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES, remembered: int = REMEMBERED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pieces of documents and their places: id, start, length, ids_crc32 (of the packed ids), doc_tokens, ids, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, the same on all executors. A document is its ids
    without special tokens and then ``end_id``; a null or empty text is ``end_id`` alone. Each id lies
    in one piece, and pieces lie in a sequence without gaps or overlap, ``length`` ids at most; what
    a sequence lacks is padding. Repeated rows are packed as often as they come. Ties in length go by a
    hash of the id and the start. Other columns are not returned.

    ``remembered`` words and ``chunk_bytes`` of text bound a worker's memory; fewer cost time and change no result.
    """
    spark = docs.sparkSession
    send_package(spark)
    tables = Tables(spark)
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = own.schema["_id"].dataType.simpleString()
    pieces = tables.write(own.mapInArrow(_pieces(tokenizer, end_id, length, remembered, chunk_bytes), f"_id {kind}, start long, _sum long, doc_tokens long, ids array<int>"), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_tie", F.xxhash64("_id", "_sum")).withColumn("_group", F.pmod(F.xxhash64("_tie", "start", F.lit(11)), F.lit(groups))).drop("_sum")
    fields = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInArrow(_pack_group(length), fields)
    return packed.withColumnRenamed("_id", id_col)
