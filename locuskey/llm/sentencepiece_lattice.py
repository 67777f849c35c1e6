"""SentencePiece encoding over a relational lattice, and decoding.

The segments of all texts (runs of characters that no piece can cross the ends of) are made distinct.
Their bounded-length substrings are exploded and equi-joined with the piece table, the matches are
grouped by segment as the edges of a lattice, and Spark's higher-order ``aggregate`` folds the lattice:
by Viterbi for a unigram model; for a BPE model, whose result Viterbi does not give, by passing once over
the edges from the best score down, each taken if it joins two neighbouring pieces. An edge that is
passed too early (see ``_late``) is seen in what the fold returns, and its segment goes through a fold that takes
the best edge over two neighbouring pieces until none is left.

Documents travel once, compressed, into blocks. A block sends its distinct segments, packed by hash
range, and gets the ids of each back in the same order, so the vocabulary of the corpus is never in
one place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import Words, chunks, distinct_runs, expand, give_back, hash_runs, spaces_but, squeeze, text_buffers

#: Parquet bytes of documents in a block.
BLOCK_BYTES = 1 << 20
#: Segments up to here keep their boundaries in the bits of one number, longer ones in a byte each.
_BITS = 61
SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _BYTE = 1, 6
_UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: normal pieces with ids and scores, ids of the byte pieces, the kind of model."""

    pieces: dict[str, tuple[int, float]]
    bytes: tuple[int, ...]
    bpe: bool
    unknown: int = 0
    prefix: bool = True

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models whose normaliser leaves texts as they are")
        if m.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == _NORMAL}
        by_byte = {p.piece: i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        fallback = tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)) if m.trainer_spec.byte_fallback else ()
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        return cls(normal, fallback, m.trainer_spec.model_type == _BPE, unknown, m.normalizer_spec.add_dummy_prefix)

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def pairs(self) -> set[tuple[str, str]]:
        """Neighbouring characters inside pieces; between others no piece can be."""
        return {(a, b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, rank, score, late): the model's size bounds it. Rank 0 is the best score; equal scores rank alike."""
        order = {s: i for i, s in enumerate(sorted({s for _, s in self.pieces.values()}, reverse=True))}
        return spark.createDataFrame([(p, i, order[s], s, self._late(p)) for p, (i, s) in self.pieces.items()], "piece string, id int, rank int, score double, late boolean")

    def _late(self, piece: str) -> bool:
        """Whether two pieces or characters make it of which one has no better score: only then can it become possible after its turn."""
        own = self.pieces[piece][1]
        part = lambda x: self.pieces[x][1] if x in self.pieces and len(x) > 1 else np.inf if len(x) == 1 else None
        cuts = ((part(piece[:j]), part(piece[j:])) for j in range(1, len(piece)))
        return any(a is not None and b is not None and min(a, b) <= own for a, b in cuts)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]


class Splitter:
    """Cuts texts into units (gap and word) on bytes, and units into segments on characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.prefix
        pairs = vocabulary.pairs()
        self.codes = np.array(sorted(ord(a) << 32 | ord(b) for a, b in pairs), np.uint64)
        # A white-space byte that can follow something else inside a piece does not begin a unit.
        inner = {b for a, b in pairs if b in " \t\n\v\f\r" or (b == SPACE and a != SPACE)}
        self.spaces = spaces_but("".join(inner).encode() if SPACE not in inner else b" \t\n\v\f\r")

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return Words(data, offsets, spaces=self.spaces, gaps=True)

    def segments(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions of the bounds of all segments of some units (``sizes``: their characters) in order, and where each unit's begin (one more)."""
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        cut = np.ones(len(points) + 1, bool)
        if len(points) > 1 and len(self.codes):
            code = points[:-1].astype(np.uint64) << np.uint64(32) | points[1:]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            cut[1:-1] = self.codes[at] != code
        unit_at = np.concatenate([[0], np.cumsum(sizes)])
        cut[unit_at] = True
        bounds = np.flatnonzero(cut)
        width = np.array([1, 2, 3, 4], np.int64)[np.searchsorted(np.array([0x80, 0x800, 0x10000], np.uint32), points, "right")]
        return np.concatenate([[0], np.cumsum(width)])[bounds], np.searchsorted(bounds, unit_at)


def _pack_documents(batches):
    """Documents of a batch, compressed together for each block; a null text is empty."""
    for batch in batches:
        block = np.asarray(batch.column("_block"))
        order = np.argsort(block, kind="stable")
        data, offsets = text_buffers(batch.column("_text"))
        raw, ends = memoryview(data), offsets.tolist()
        rows, names, blobs = [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if not len(part):
                continue
            rows.append(int(block[part[0]]))
            names.append(batch.column("_id").take(pa.array(part)).to_pylist())
            blobs.append(squeeze([raw[ends[i] : ends[i + 1]] for i in part.tolist()]))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.list_(batch.column("_id").type)), pa.array(blobs, pa.binary())], names=["_block", "_ids", "_texts"])
        del raw, data, batch, blobs
        give_back()


class _Block:
    """A block's documents, its distinct units and their segments."""

    def __init__(self, table: pa.Table, splitter: Splitter, ranges: int):
        self.splitter = splitter
        self.ids = [i for ids in table.column("_ids").to_pylist() for i in ids]
        texts = [t for blob in table.column("_texts").to_pylist() for t in expand(blob)]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        firsts, starts, ends, hashes, leads = [], [], [], [], []
        for a, b in chunks(self.data, self.offsets):
            u = self.splitter.units(self.data, self.offsets[a : b + 1])
            firsts.append(u.first)
            starts.append(u.starts + self.offsets[a])
            ends.append(u.ends + self.offsets[a])
            # The first unit of a row has the model's prefix before it.
            lead = np.zeros(len(u.starts), bool)
            lead[u.first[:-1][np.diff(u.first) > 0]] = self.splitter.prefix
            leads.append(lead)
            hashes.append(np.where(lead, u.hashes ^ np.uint64(0x5851F42D4C957F2D), u.hashes))
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        starts, ends, lead = join(starts, np.int64), join(ends, np.int64), join(leads, bool)
        sample, which = distinct_runs(self.data, starts, ends, join(hashes, np.uint64))
        self.parts = [(f, w) for f, w in zip(firsts, np.split(which, np.cumsum([f[-1] for f in firsts])[:-1]) if firsts else [], strict=True)]
        # The distinct units one after the other; a prefix is a space before them, and spaces become the model's sign.
        raw = self.data.tobytes()
        units = [b" " + raw[s:e] if p else raw[s:e] for s, e, p in zip(starts[sample].tolist(), ends[sample].tolist(), lead[sample].tolist(), strict=True)]
        joined = b"".join(units)
        first_bytes = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
        at = first_bytes[np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)]
        joined = joined.replace(b" ", SPACE.encode())
        bounds, self.unit_at = self.splitter.segments(joined, np.diff(at))
        flat = np.frombuffer(joined, np.uint8)
        hashes = hash_runs(flat, bounds[:-1], bounds[1:])
        sample, self.segment_of = distinct_runs(flat, bounds[:-1], bounds[1:], hashes)
        self.segments = [joined[s:e] for s, e in zip(bounds[sample].tolist(), bounds[sample + 1].tolist(), strict=True)]
        lots = (((hashes[sample] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
        by_lot = np.argsort(lots, kind="stable")
        self.lots = {int(lots[p[0]]): p for p in np.split(by_lot, np.flatnonzero(np.diff(lots[by_lot])) + 1) if len(p)}


def _send_segments(splitter: Splitter, ranges: int):
    def run(key, table):
        block = _Block(table, splitter, ranges)
        give_back()
        lots = list(block.lots.items())
        return pa.table({"_range": pa.array([r for r, _ in lots], pa.int64()), "_block": pa.array([key[0].as_py()] * len(lots), pa.int64()), "_segments": pa.array([squeeze([block.segments[i] for i in p.tolist()]) for _, p in lots], pa.binary())})

    return run


def _distinct_segments(key, table):
    found = sorted({s for blob in table.column("_segments").to_pylist() for s in expand(blob)})
    return pa.table({"_range": pa.array([key[0].as_py()] * len(found), pa.int64()), "segment": pa.array(found, pa.binary()).cast(pa.string())})


def _answer():
    def run(key, asked, encoded):
        encoded = encoded.combine_chunks()
        known = {s: i for i, s in enumerate(encoded.column("segment").cast(pa.binary()).to_pylist())}
        lists = encoded.column("ids").combine_chunks()
        values, ends = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets).astype(np.int64)
        blobs = []
        for blob in asked.column("_segments").to_pylist():
            # A segment that the lattice lost is an error, not something to encode in another way.
            at = np.array([known[s] for s in expand(blob)], np.int64)
            counts = ends[at + 1] - ends[at]
            blobs.append(zstandard.ZstdCompressor(level=1).compress(counts.astype("<u4").tobytes() + values[_gather(ends[at], counts)].tobytes()))
        return pa.table({"_block": asked.column("_block"), "_range": asked.column("_range"), "_encoded": pa.array(blobs, pa.binary())})

    return run


def _gather(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of runs begin[i] .. begin[i] + count[i], one run after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - count), count) + np.arange(total)


def _finish(splitter: Splitter, decoder: _Decoder, ranges: int):
    def run(docs, answers):
        block = _Block(docs, splitter, ranges)
        give_back()
        count = np.zeros(len(block.segments), np.int64)
        begin = np.zeros(len(block.segments), np.int64)
        flats, at = [], 0
        for r, blob in zip(answers.column("_range").to_pylist(), answers.column("_encoded").to_pylist(), strict=True):
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u4")
            p = block.lots[r]
            count[p] = raw[: len(p)]
            begin[p] = at + np.cumsum(raw[: len(p)]) - raw[: len(p)]
            flats.append(raw[len(p) :])
            at += len(flats[-1])
        flat = np.concatenate([*flats, np.zeros(0, "<u4")]).astype("<u4")
        # Ids of segments, then of units, then of texts.
        seg = block.segment_of
        unit_ids = flat[_gather(begin[seg], count[seg])]
        seg_ends = np.concatenate([[0], np.cumsum(count[seg])])
        unit_begin = seg_ends[block.unit_at[:-1]]
        unit_count = seg_ends[block.unit_at[1:]] - unit_begin
        n_pieces, sums, same, ids = [], [], [], []
        row = 0
        raw = block.data.tobytes()
        for first, place in block.parts:
            own = unit_ids[_gather(unit_begin[place], unit_count[place])]
            ends = np.concatenate([[0], np.cumsum(unit_count[place])])[first]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                piece = own[a:b]
                n_pieces.append(b - a)
                sums.append(zlib.crc32(piece.tobytes()))
                same.append(decoder.decode(piece) == raw[block.offsets[row] : block.offsets[row + 1]])
                ids.append(piece.astype(np.int32))
                row += 1
        out = {"_id": pa.array(block.ids, docs.schema.field("_ids").type.value_type), "n_pieces": pa.array(n_pieces, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "round_trip": pa.array(same, pa.bool_())}
        out["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.table(out)

    return run


class _Decoder:
    """Ids to bytes through one flat array of all pieces. Like the splitter it is made once and goes to the tasks, which need no model."""

    def __init__(self, path: str):
        parts = _piece_bytes(path)
        self.count = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text; the space that the model's prefix put first is taken off."""
        out = self.flat[_gather(self.begin[ids], self.count[ids])].tobytes() if len(ids) else b""
        return out[1:] if out[:1] == b" " else out


def _piece_bytes(path: str) -> list[bytes]:
    """What each id stands for; nothing for control pieces."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    text = {_BYTE: lambda p: bytes([int(p[3:5], 16)]), 3: lambda p: b"", 2: lambda p: " ⁇ ".encode()}
    return [text.get(p.type, lambda x: x.replace(SPACE, " ").encode())(p.piece) for p in m.pieces]


# The lattice.


def edges(segments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``segments`` (segment and _range, a function of it) with the substrings i..k that are pieces: ``chars``, (i, id, score) of
    each character in order (id null if it is no piece), and ``edges``, those of more characters, in order of rank and begin.

    The piece table is as large as the model, so it is broadcast. Where segments are partitioned by
    _range they stay so: the edges are grouped without another shuffle.
    """
    longest = vocabulary.longest
    starts = segments.select("_range", "segment", F.explode(F.sequence(F.lit(0), F.length("segment") - 1)).alias("i"))
    spans = starts.select("_range", "segment", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("segment") - F.col("i")))).alias("n"))
    pieces = F.broadcast(vocabulary.table(segments.sparkSession))
    found = spans.select("_range", "segment", "i", "n", F.substring("segment", F.col("i") + 1, F.col("n")).alias("piece")).join(pieces, "piece", "left").where("id is not null or n = 1")
    # Of each edge also the bits from its begin to its end, and these two.
    bits = {"span": "case when i + n <= {0} then shiftleft(shiftleft(1L, n + 1) - 1, i) end", "ends": "case when i + n <= {0} then shiftleft(1L, i) | shiftleft(1L, i + n) end"}
    edge = F.struct("rank", "i", (F.col("i") + F.col("n")).alias("k"), "id", "score", "late", *[F.expr(x.format(_BITS)).alias(c) for c, x in bits.items()])
    return found.groupBy("_range", "segment").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") == 1, F.struct("i", "id", "score")))).alias("chars"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, edge))).alias("edges"),
    )


def _fallback(vocabulary: Vocabulary, segment: Column, i: Column, k: Column) -> Column:
    text = F.substring(segment, i + 1, k - i)
    if not vocabulary.bytes:
        return F.array(F.lit(vocabulary.unknown))
    table = F.array(*map(F.lit, vocabulary.bytes))
    digits = F.hex(F.encode(text, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda p: F.get(table, F.conv(F.substring(digits, p, F.lit(2)), 16, 10).cast("int")))


def fold(lattice: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(_range, segment, ids) of what ``edges`` returns."""
    s, c, e, gone = F.col("segment"), F.col("chars"), F.col("edges"), F.col("gone")
    if not vocabulary.bpe:
        return lattice.select("_range", "segment", _fold_viterbi(vocabulary, s, c, e).alias("ids"))
    passed = lattice.withColumn("gone", F.when(F.length(s) <= _BITS, _pass_bits(e)).otherwise(_pass_bytes(s, e)))
    bounds = F.when(_too_early(e, gone), _fold_merges(s, e)).otherwise(_bounds(s, gone))
    return passed.withColumn("bounds", bounds).select("_range", "segment", _ids_between(vocabulary, s, c, e, F.col("bounds")).alias("ids"))


_GONE = "array<struct<at:int,rank:int>>"


def _pass_bits(e: Column) -> Column:
    """The boundaries that edges in order of rank take away, each with its edge's rank; boundaries are bits of one number."""
    start = F.struct(F.expr("shiftleft(1L, length(segment) + 1) - 1").alias("b"), F.array().cast(_GONE).alias("gone"))

    def step(state: Column, x: Column) -> Column:
        inside = state["b"].bitwiseAND(x["span"])
        middle = inside.bitwiseXOR(x["ends"])
        ready = (F.bit_count(inside) == 3) & (inside.bitwiseAND(x["ends"]) == x["ends"])
        taken = F.struct(F.bit_count(middle - 1).alias("at"), x["rank"].alias("rank"))
        return F.when(ready, F.struct(state["b"].bitwiseXOR(middle).alias("b"), F.concat(state["gone"], F.array(taken)).alias("gone"))).otherwise(state)

    return F.aggregate(e, start, step, lambda state: state["gone"])


def _pass_bytes(s: Column, e: Column) -> Column:
    """Like ``_pass_bits``, with a byte for each boundary."""
    one, zero = (F.lit(x).cast("binary") for x in "10")
    start = F.struct(F.repeat(F.lit("1"), F.length(s) + 1).cast("binary").alias("b"), F.array().cast(_GONE).alias("gone"))

    def step(state: Column, x: Column) -> Column:
        inside = F.substring(state["b"], x["i"] + 1, x["k"] - x["i"] + 1).cast("string")
        at = x["i"] + F.call_function("locate", F.lit("1"), inside, F.lit(2)) - 1
        taken = F.struct(at.cast("int").alias("at"), x["rank"].alias("rank"))
        return F.when(inside.rlike("^10*10*1$"), F.struct(F.overlay(state["b"], zero, at + 1, F.lit(1)).alias("b"), F.concat(state["gone"], F.array(taken)).alias("gone"))).otherwise(state)

    return F.aggregate(e, start, step, lambda state: state["gone"])


def _too_early(e: Column, gone: Column) -> Column:
    """Whether an edge had two boundaries or more inside at its turn, and just one later, while its ends were there."""

    def passed(x: Column) -> Column:
        inside = F.filter(gone, lambda g: (g["at"] > x["i"]) & (g["at"] < x["k"]))
        gone_before = lambda last: F.slice(gone, 1, F.array_position(gone, last).cast("int"))
        at_an_end = lambda g: (g["at"] == x["i"]) | (g["at"] == x["k"])
        # An array of none or one: what left just one boundary inside.
        return F.exists(F.slice(inside, x["k"] - x["i"] - 2, F.lit(1)), lambda last: (last["rank"] >= x["rank"]) & ~F.exists(gone_before(last), at_an_end))

    return F.exists(F.filter(e, lambda x: x["late"] & (x["k"] - x["i"] > 2)), passed)


def _bounds(s: Column, gone: Column) -> Column:
    return F.array_except(F.sequence(F.lit(0), F.length(s)), F.transform(gone, lambda g: g["at"]))


def _fold_merges(s: Column, e: Column) -> Column:
    """Boundaries between pieces, at first all characters'; each step removes the one inside the best edge that has just one inside."""
    start = F.struct(F.sequence(F.lit(0), F.length(s)).alias("b"), e.alias("live"))

    def step(state: Column, _: Column) -> Column:
        b, live = state["b"], state["live"]
        ready = F.filter(live, lambda x: F.array_position(b, x["k"]) - F.array_position(b, x["i"]) == 2)
        # An array of none or one, so that what is found is worked out once.
        chosen = F.transform(F.slice(ready, 1, 1), lambda x: F.get(b, F.array_position(b, x["i"]).cast("int")))
        moved = F.transform(chosen, lambda m: F.struct(F.array_remove(b, m).alias("b"), F.filter(live, lambda x: (x["i"] != m) & (x["k"] != m)).alias("live")))
        return F.coalesce(F.get(moved, F.lit(0)), F.struct(b.alias("b"), F.slice(live, 1, 0).alias("live")))

    steps = F.slice(F.sequence(F.lit(0), F.length(s)), 1, F.length(s) - 1)
    return F.aggregate(steps, start, step, lambda state: state["b"])


def _ids_between(vocabulary: Vocabulary, s: Column, c: Column, e: Column, b: Column) -> Column:
    """The ids of the pieces between boundaries; a character that is no piece gives its bytes'."""

    def ids(i: Column, k: Column) -> Column:
        own = F.filter(e, lambda x: (x["i"] == i) & (x["k"] == k))
        char = F.get(c, i)["id"]
        return F.when(k - i > 1, F.array(F.get(own, F.lit(0))["id"])).when(char.isNotNull(), F.array(char)).otherwise(_fallback(vocabulary, s, i, k))

    return F.flatten(F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), ids))


def _fold_viterbi(vocabulary: Vocabulary, s: Column, c: Column, e: Column) -> Column:
    """The best (score, ids) up to each character, edges taken in order of their ends."""
    worst = min((x for _, x in vocabulary.pieces.values()), default=0.0) - _UNKNOWN_PENALTY
    none = F.struct(F.lit(float("-inf")).alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.transform(F.sequence(F.lit(0), F.length(s)), lambda p: F.when(p == 0, F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).otherwise(none))
    known = F.transform(e, lambda x: F.struct(x["k"].alias("k"), x["i"].alias("i"), F.array(x["id"]).alias("ids"), x["score"].alias("score")))
    one = lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(_fallback(vocabulary, s, x["i"], x["i"] + 1))
    spelled = F.transform(c, lambda x: F.struct((x["i"] + 1).alias("k"), x["i"].alias("i"), one(x).alias("ids"), F.coalesce(x["score"], F.lit(worst)).alias("score")))

    def step(best: Column, x: Column) -> Column:
        before = F.get(best, x["i"])
        score = before["score"] + x["score"]
        return F.transform(best, lambda old, at: F.when((at == x["k"]) & (score > old["score"]), F.struct(score.alias("score"), F.concat(before["ids"], x["ids"]).alias("ids"))).otherwise(old))

    return F.aggregate(F.sort_array(F.concat(known, spelled)), start, step, lambda best: F.get(best, F.length(s))["ids"])


def encode_segments(segments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(_range, segment, ids) of distinct, non-empty segments (_range, segment)."""
    return fold(edges(segments, vocabulary), vocabulary)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, n_pieces, ids_crc32 (unsigned, of the ids as little-endian 32-bit numbers), round_trip (whether the ids decode to the text), ids.

    ``model`` is the path of a SentencePiece model, the same on all executors. A null or empty text has no
    ids. Characters without a piece become byte pieces. Repeated rows are encoded as often as they come.
    Other columns are not returned.
    """
    spark = docs.sparkSession
    send_package(spark)
    vocabulary = Vocabulary.load(model)
    splitter = Splitter(vocabulary)
    n = blocks_for(docs.select(F.col(f"`{text}`")), block_bytes)
    own = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.spark_partition_id(), F.col(f"`{text}`")), F.lit(n)).alias("_block"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = own.schema["_id"].dataType
    packed = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_ids", T.ArrayType(kind)), T.StructField("_texts", T.BinaryType())])
    blocks = own.mapInArrow(_pack_documents, packed).repartition(tasks_for(n), "_block")
    asked = blocks.groupBy("_block").applyInArrow(_send_segments(splitter, n), "_range long, _block long, _segments binary").repartition(tasks_for(n), "_range")
    distinct = asked.groupBy("_range").applyInArrow(_distinct_segments, "_range long, segment string")
    encoded = encode_segments(distinct.repartition(tasks_for(n), "_range"), vocabulary)
    answers = asked.groupBy("_range").cogroup(encoded.groupBy("_range")).applyInArrow(_answer(), "_block long, _range long, _encoded binary")
    fields = [T.StructField("_id", kind), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    out = blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_finish(splitter, _Decoder(model), n), T.StructType(fields))
    return out.withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of an array of ids; null for null, and ids outside the model stand for nothing.

    The pieces are a constant array of the model's size; byte pieces are put together before they are read as UTF-8.
    """
    table = F.array(*[F.lit(x.hex().upper()) for x in _piece_bytes(model)])
    digits = F.array_join(F.transform(F.col(ids), lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")
    return rows.withColumn(into, F.regexp_replace(F.decode(F.unhex(digits), "utf-8"), "^ ", ""))
