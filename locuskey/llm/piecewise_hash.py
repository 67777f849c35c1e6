"""Context-triggered piecewise hashing: fingerprints of whole texts, compared by edit distance.

A hash of the last eight bytes rolls over the text. Where its lowest k bits are zero a piece ends, so a piece's ends depend on their
neighbourhood alone, and a piece gives one symbol of the signature. A fingerprint ``k:signature:signature:signature`` has the
signatures for k, k + 1 and k + 2, k being the least for which there are few enough pieces: block size 2**k. Fingerprints are
compatible where they have a block size in common, so half a text and the whole are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import Tables, blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import chunks, finalise, give_back, text_buffers

#: Pieces of a signature at most.
PIECES = 64
#: Block sizes of a fingerprint, each twice the one before.
LEVELS = 3
#: Bytes that the rolling hash sees.
WINDOW = 8
#: Bytes hashed at once, whatever the texts' lengths.
SEGMENT = 1 << 20
#: Parquet bytes of documents in a partition.
BLOCK_BYTES = 6 << 20

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TWO = np.frombuffer(b"".join(bytes([a, b]) for a in _ALPHABET for b in _ALPHABET), np.uint16)
_VALUE = np.zeros(256, np.uint16)
_VALUE[list(_ALPHABET)] = np.arange(64)
_SALT = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def _hashes(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For the bytes from ``lo`` to ``hi``: a hash of the last eight bytes, of their own row only."""
    back = min(lo, WINDOW - 1)
    near = np.concatenate([np.zeros(WINDOW - 1 - back, np.uint8), data[lo - back : hi]])
    w = np.ndarray((hi - lo,), "<u8", buffer=near.tobytes(), strides=(1,)).copy()
    first, last = np.searchsorted(offsets, [lo - WINDOW + 2, hi])
    starts, ends = offsets[first:last], offsets[np.minimum(np.arange(first, last) + 1, len(offsets) - 1)]
    for d in range(WINDOW - 1):
        at = (starts + d)[(starts + d >= lo) & (starts + d < np.minimum(ends, hi))] - lo
        foreign = np.uint64(8 * (WINDOW - 1 - d))
        w[at] = (w[at] >> foreign) << foreign
    return finalise(w + _SALT)


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """k of each row of some texts' bytes, and for k, k + 1 and k + 2 (symbols of all rows, each row's first)."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    size = np.diff(offsets)
    rows = len(size)
    # No row has so few pieces for a lower k but by repeating itself.
    least = np.maximum(np.floor(np.log2(np.maximum(size, 1) / PIECES)) - 1, 0).astype(np.uint64)
    mask = (_ONE << least) - _ONE
    places, zeros, sums, before = [], [], [], np.uint64(0)
    for lo in range(0, len(data), SEGMENT):
        hi = min(lo + SEGMENT, len(data))
        h = _hashes(data, offsets, lo, hi)
        total = np.cumsum(h)
        total += before
        before = total[-1]
        a, b = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left")
        inside = np.minimum(offsets[a + 1 : b + 1], hi) - np.maximum(offsets[a:b], lo)
        candidate = (h & np.repeat(mask[a:b], inside)) == 0
        ends = offsets[a + 1 : b + 1][size[a:b] > 0] - 1
        candidate[ends[ends < hi] - lo] = True
        at = np.flatnonzero(candidate)
        x = h[at]
        places.append(at + lo)
        zeros.append(np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64))
        sums.append(total[at])
    if not places:
        return np.zeros(rows, np.int64), [(np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64))] * LEVELS
    places, zeros, sums = (np.concatenate(x) for x in (places, zeros, sums))
    row = np.searchsorted(offsets, places, "right") - 1
    final = places + 1 == offsets[row + 1]
    found = np.bincount(row * 66 + zeros, minlength=rows * 66).reshape(rows, 66)
    enough = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] < PIECES
    enough[np.arange(66) < least.astype(np.int64)[:, None]] = False
    k = np.where(size > 0, np.argmax(enough, axis=1), 0)
    out = []
    for level in (k + i for i in range(LEVELS)):
        pick = final | (zeros >= level[row])
        symbols = finalise(np.diff(sums[pick], prepend=np.uint64(0))) >> np.uint64(52)
        out.append((symbols.astype(np.uint16), np.searchsorted(row[pick], np.arange(rows + 1))))
    return k, out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The fingerprint of each row of some texts' bytes."""
    k, found = signatures(data, offsets)
    signs = [(_TWO[symbols].tobytes().decode("ascii"), (2 * first).tolist()) for symbols, first in found]
    return [":".join([str(x), *(s[at[i] : at[i + 1]] for s, at in signs)]) for i, x in enumerate(k.tolist())]


def _pad(signs: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full((len(signs), PIECES), fill, np.uint16)
    size = np.array([len(s) // 2 for s in signs], np.int64)
    raw = _VALUE[np.frombuffer("".join(signs).encode("ascii"), np.uint8)]
    out[np.arange(PIECES) < size[:, None]] = raw[::2] * 64 + raw[1::2]
    return out, size


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    """1 - edit distance / length of both, a replaced symbol counting as one taken out and one put in; 0 if both are empty."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 4096):
        (x, n), (y, m) = _pad(a[lo : lo + 4096], 65535), _pad(b[lo : lo + 4096], 65534)
        # The longest common subsequence by adding in rows of bits: a zero bit for each symbol of it.
        v = np.full(len(x), ~np.uint64(0))
        for j in range(int(m.max(initial=0))):
            u = v & np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view("<u8").ravel()
            v = (v + u) | (v - u)
        common = np.bitwise_count(~v).astype(np.int64)
        distance = n + m - 2 * common
        out[lo : lo + 4096] = np.where(n + m > 0, 1 - distance / np.maximum(n + m, 1), 0.0)
    return out


def likeness_of(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """The likeness of each two fingerprints, see ``likeness``."""
    out = np.array([1.0 if x == y and x is not None else 0.0 for x, y in zip(a, b, strict=True)])
    pairs, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None or x == y:
            continue
        k, *s = x.split(":")
        j, *t = y.split(":")
        k, j = int(k), int(j)
        for level in range(max(k, j), min(k, j) + LEVELS):
            pairs.append(i)
            left.append(s[level - k])
            right.append(t[level - j])
    np.maximum.at(out, np.array(pairs, np.int64), _alike(left, right))
    return out


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: 1 for equal ones; else by the edit distance of their signatures at a common block size, the greatest of several; 0 without one or for a null."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(likeness_of([None if pd.isna(v) else v for v in x], [None if pd.isna(v) else v for v in y]))

    return compare(a, b)


def _fingerprint(name: str, text: str):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            found = [f for a, b in chunks(data, offsets) for f in fingerprints_of(data, offsets[a : b + 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])
        give_back()

    return run


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as ``name`` (in the place of a column named so). No shuffle; null counts as the empty text, whose fingerprint is ``0:::``."""
    send_package(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name])
    return docs.mapInArrow(_fingerprint(name, text), T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])


def _compared(texts: list[str], prints: list[str], keep: bool) -> dict[str, list]:
    """Columns of all texts but the last, each with the next one."""
    edited = []
    for a, b in zip(texts[:-1], texts[1:], strict=True):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    data, offsets = _bytes_of(edited)
    new = [f for a, b in chunks(data, offsets) for f in fingerprints_of(data, offsets[a : b + 1])]
    raw = data.tobytes()
    return {
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)],
        "fingerprint": prints[:-1],
        "edited_fingerprint": new,
        "near_edited": likeness_of(prints[:-1], new).tolist(),
        "near_next": likeness_of(prints[:-1], prints[1:]).tolist(),
        "edited_text": edited if keep else [None] * len(edited),
    }


_RESULT = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "edited_text": pa.string()}
_EDGE = {"_part": pa.int64(), "_first": pa.bool_(), "_text": pa.string()}
_RESULT_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_text string"


def _neighbours(keep: bool):
    """Rows in order: each with the next of its partition; and the partition's first and last row with their texts, to be joined to other partitions'."""

    def batch(rows: list[pa.Array], result: dict[str, list], edge: dict[str, list]):
        row = pa.concat_arrays(rows)
        gone = [None] * len(row)
        return pa.RecordBatch.from_arrays([row, *(pa.array(result.get(c, gone), t) for c, t in _RESULT.items()), *(pa.array(edge.get(c, gone), t) for c, t in _EDGE.items())], names=["_row", *_RESULT, *_EDGE])

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            data, offsets = text_buffers(b.column("_text"))
            for first, last in chunks(data, offsets):
                texts = [t or "" for t in b.column("_text").slice(first, last - first).to_pylist()]
                prints, row = fingerprints_of(data, offsets[first : last + 1]), b.column("_row").slice(first, last - first)
                if held is None:
                    yield batch([row.slice(0, 1)], {"fingerprint": prints[:1]}, {"_part": [part], "_first": [True], "_text": texts[:1]})
                    rows = [row.slice(0, len(texts) - 1)]
                else:
                    rows, texts, prints = [held[0], row.slice(0, len(texts) - 1)], [held[1], *texts], [held[2], *prints]
                yield batch(rows, _compared(texts, prints, keep), {})
                held = (row.slice(len(row) - 1, 1), texts[-1], prints[-1])
        if held is not None:
            yield batch([held[0]], {"fingerprint": [held[2]]}, {"_part": [part], "_first": [False], "_text": [held[1]]})
        give_back()

    return run


def _finish(keep: bool):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                texts, prints = [b.column(c)[i].as_py() for c in ("_text", "_next_text")], [b.column(c)[i].as_py() for c in ("_print", "_next_print")]
                found = _compared(texts, prints, keep)
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(i, 1), *(pa.array(found[c], t) for c, t in _RESULT.items())], names=["_row", *_RESULT])

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_edited: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` but the text, and n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; with ``keep_edited`` edited_text.

    A row's edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's, in the
    order of the id (nulls last; rows of one id in the order of their texts' hashes); after the last row comes the first. near_edited is the likeness of the fingerprints of a
    text and its edited text, near_next of a text's and the next text's. Texts are shuffled once, by ranges of the id; what a
    partition's last row needs of the next partition is joined afterwards, two rows a partition. Null texts count as empty; the likeness of two
    empty texts is 1, of an empty and another 0. A single row is its own next row; no rows give none. Of columns named like a result, the result is returned.
    """
    spark = docs.sparkSession
    send_package(spark)
    tables = Tables(spark)
    carried = [c for c in docs.columns if c != text]
    # A tie's order is that of a hash and the text's length: what is left equal is equal text.
    x = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(x).alias("_tie"), x.alias("_text"), F.struct(*[F.col(f"`{c}`") for c in carried] or [F.lit(None).alias("_none")]).alias("_row"))
    order = [F.asc_nulls_last("_id"), F.asc("_tie")]
    ordered = rows.repartitionByRange(tasks_for(blocks_for(docs, block_bytes)), *order).sortWithinPartitions(*order, F.asc_nulls_first("_text"))
    schema = T.StructType.fromDDL(f"{_RESULT_DDL}, _part long, _first boolean, _text string")
    part = tables.write(ordered.select("_row", "_text").mapInArrow(_neighbours(keep_edited), T.StructType([rows.schema["_row"], *schema.fields])), "neighbours")
    edges = part.where("_part is not null").select("_row", "_part", "_first", F.col("_text"), F.col("fingerprint").alias("_print"))
    parts = sorted(r._part for r in edges.where("_first").select("_part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "_part long, _next long")
    heads = edges.where("_first").select(F.col("_part").alias("_next"), F.col("_text").alias("_next_text"), F.col("_print").alias("_next_print"))
    pairs = edges.where("not _first").select("_row", "_part", "_text", "_print").join(following, "_part").join(heads, "_next").select("_row", "_text", "_print", "_next_text", "_next_print")
    done = pairs.mapInArrow(_finish(keep_edited), T.StructType([rows.schema["_row"], *T.StructType.fromDDL(_RESULT_DDL).fields]))
    new = [c for c in _RESULT if keep_edited or c != "edited_text"]
    out = part.where("_part is null").select("_row", *_RESULT).unionByName(done)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in carried if c not in new], *new)
