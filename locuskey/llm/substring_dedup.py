"""Substring dedup: words inside word windows that occur more than once in the corpus are removed.

Documents are dealt into blocks. Each block hashes its windows (Rabin-Karp modulo a prime of 61 bits) and sends the distinct
hashes, packed by hash range, to be counted; every range answers each block with the hashes that
occur again somewhere. The block then merges repeated windows into maximal intervals.
A window that everybody shares travels once per block, so no key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import Words, chunks, joined, text_buffers

#: Parquet bytes of documents in a block.
BLOCK_BYTES = 4 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept_text", T.StringType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def _window_hashes(width: int, ranges: int):
    def run(key, table):
        data, offsets = text_buffers(table.column("_text"))
        found = [Words(data, offsets[a : b + 1]).prime_windows(width)[0] for a, b in chunks(data, offsets)]
        hashes, counts = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        lot = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cut = np.flatnonzero(np.diff(lot)) + 1
        edges = [0, *cut.tolist(), len(hashes)] if len(hashes) else [0]
        parts = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.table(
            {
                "_range": pa.array([int(lot[a]) for a, _ in parts], pa.int64()),
                "_block": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                "_hashes": pa.array([hashes[a:b].tobytes() for a, b in parts], pa.binary()),
                "_again": pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in parts], pa.binary()),
            }
        )

    return run


def _repeated(table):
    blocks = table.column("_block").to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in table.column("_hashes").to_pylist()]
    again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("_again").to_pylist(), parts, strict=True)]
    every = np.concatenate(parts)
    order = np.sort(every)
    twice = order[1:][order[1:] == order[:-1]]
    wanted = np.unique(np.concatenate([twice, every[np.concatenate(again)]]))
    out_blocks, out = [], []
    for b, p in zip(blocks, parts, strict=True):
        hit = p[_member(p, wanted)]
        if len(hit):
            out_blocks.append(b)
            out.append(hit.tobytes())
    return pa.table({"_block": pa.array(out_blocks, pa.int64()), "_repeated": pa.array(out, pa.binary())})


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _remove(width: int, keep_spaces: bool):
    def run(docs, answers):
        wanted = np.unique(np.concatenate([*(np.frombuffer(x, np.uint64) for x in answers.column("_repeated").to_pylist()), np.zeros(0, np.uint64)]))
        data, offsets = text_buffers(docs.column("_text"))
        nulls = docs.column("_text").is_null().to_pylist()
        n_words, n_removed, spans, texts, digests = [], [], [], [], []
        for a, b in chunks(data, offsets):
            words = Words(data, offsets[a : b + 1])
            hashes, at = words.prime_windows(width)
            hit = at[_member(hashes, wanted)]
            step = np.zeros(len(words.starts) + 1, np.int64)
            step[hit] += 1
            step[hit + width] -= 1
            covered = np.cumsum(step[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            raw = words.bytes.tobytes()
            for r in range(b - a):
                first, end = int(words.first[r]), int(words.first[r + 1])
                gone = int(total[end] - total[first])
                whole = raw[words.offsets[r] : words.offsets[r + 1]]
                if not gone:
                    kept, own = joined(whole), []
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[first:end], [False]]).astype(np.int8)))
                    own = [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
                    left = [0, *(e for _, e in own)]
                    right = [*(s for s, _ in own), end - first]
                    kept = b" ".join(joined(raw[words.starts[first + s] : words.ends[first + e - 1]]) for s, e in zip(left, right, strict=True) if s < e)
                n_words.append(end - first)
                n_removed.append(gone)
                spans.append([{"start": s, "end": e} for s, e in own])
                if keep_spaces:
                    left = [0, *(int(words.ends[first + e - 1]) - int(words.offsets[r]) for _, e in own)]
                    right = [*(int(words.starts[first + s]) - int(words.offsets[r]) for s, _ in own), len(whole)]
                    cut = b"".join(whole[s:e] for s, e in zip(left, right, strict=True))
                    texts.append(None if nulls[len(texts)] else cut.decode("utf-8", "replace"))
                else:
                    texts.append(kept.decode("utf-8", "replace"))
                digests.append(hashlib.sha256(kept).hexdigest())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(
            {
                "_row": docs.column("_row"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "removed_spans": pa.array(spans, pa.list_(span)),
                "kept_text": pa.array(texts, pa.string()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    return run


def remove_repeated_windows(docs: DataFrame, width: int = 35, text: str = "text", block_bytes: int = BLOCK_BYTES, keep_spaces: bool = False) -> DataFrame:
    """All columns of ``docs``, and n_words, n_removed, removed_spans (word positions, end exclusive), kept_text, kept_sha256.

    Words are cut at ASCII white space and compared unchanged; a window whose word sequence starts
    anywhere else as well, in the same document too, loses all its words. Null and empty texts have
    no words and keep the empty text; rows are documents of their own, so repeated rows (whatever
    their ids) repeat each other's windows; texts shorter than ``width`` words stay whole. Of
    columns that are named like a result, the result is returned. With ``keep_spaces`` kept_text is the
    text itself (null for a null) without the bytes of the removed spans; kept_sha256 is the same either way.
    """
    spark = docs.sparkSession
    send_package(spark)
    n = blocks_for(docs, block_bytes)
    carried = [c for c in docs.columns if c != text]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(f"`{text}`"), F.struct(*[F.col(f"`{c}`").cast("string") for c in carried[:1]])), F.lit(n)).alias("_block"),
        F.col(f"`{text}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in carried] or [F.lit(None).alias("_none")]).alias("_row"),
    ).repartition(tasks_for(n), "_block")
    kept = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), *RESULT.fields])
    sent = rows.groupBy("_block").applyInArrow(_window_hashes(width, n), "_range long, _block long, _hashes binary, _again binary")
    answers = sent.groupBy("_range").applyInArrow(_repeated, "_block long, _repeated binary")
    out = rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_remove(width, keep_spaces), kept)
    new = {f.name for f in RESULT.fields}
    return out.select(*[F.col("_row").getField(c).alias(c) for c in carried if c not in new], *[F.col(c) for c in RESULT.names])
