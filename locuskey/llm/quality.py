"""Quality classifier by positive-unlabelled learning.

The model is a logistic function of text statistics and hashed words. It is fitted to trusted positives
and to unlabelled text by minimising the non-negative unbiased risk: with class prior p,

    p * R(positives as +) + max(0, R(unlabelled as -) - p * R(positives as -)),

in which, where the second part falls below zero, the step goes against it instead.

The prior is estimated from the same two samples: a classifier of positives against unlabelled texts is
fitted to one half of them, and on the other half the least ratio of the shares that reach a score,
unlabelled to positives, bounds the share of positives among the unlabelled from above.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import send_package
from locuskey.llm.splits import bounded, fold, with_text
from locuskey.llm.textkernel import Words, chunks, give_back, text_buffers

#: Rows that the fit uses at most, about: positives, and unlabelled ones.
POSITIVES = 12_000
UNLABELLED = 24_000

_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_group = np.full(256, len(_SIGNS) + 5, np.int64)  # other: controls
for _i, _b in enumerate(_SIGNS):
    _group[_b] = _i
_group[48:58] = len(_SIGNS)
_group[65:91] = len(_SIGNS) + 1
_group[97:123] = len(_SIGNS) + 2
_group[128:] = len(_SIGNS) + 3
_group[[9, 10, 11, 12, 13, 32]] = len(_SIGNS) + 4
_GROUPS = len(_SIGNS) + 6
#: Buckets of hashed words.
_HASHED = 64
N_FEATURES = _GROUPS + 14 + _HASHED


def _per_row(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Different hashes per row."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1).astype(float)


def features(words: Words) -> np.ndarray:
    """A row of statistics for each text: shares of signs and letters, of odd words, of repeated words and lines, and lengths."""
    n = len(words.first) - 1
    b, offsets = words.bytes, words.offsets
    lengths = np.diff(offsets).astype(float)
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.bincount(rows * _GROUPS + _group[b], minlength=n * _GROUPS).reshape(n, _GROUPS).astype(float)
    shares = counts / np.maximum(lengths, 1)[:, None]
    starts, ends, first = words.starts, words.ends, words.first
    n_words = np.diff(first).astype(float)
    per = np.maximum(n_words, 1)
    size = (ends - starts).astype(float)
    head, tail = (b[starts], b[ends - 1]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    upper = lambda x: (x >= 65) & (x <= 90)
    letter = lambda x: upper(x) | ((x >= 97) & (x <= 122)) | (x >= 128)
    second = b[np.minimum(starts + 1, ends - 1)] if len(starts) else head
    mean = _per_row(first, size) / per
    spread = np.sqrt(np.maximum(_per_row(first, size * size) / per - mean * mean, 0))
    breaks = np.flatnonzero(b == 10)
    lines = np.searchsorted(breaks, offsets)
    n_lines = np.diff(lines) + 1.0
    # Lines by the hashes of their words: a prefix sum of word hashes at each line break.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes)])
    bounds = np.sort(np.concatenate([breaks, offsets]))
    at = np.searchsorted(starts, bounds)
    line_hash, line_row = np.diff(total[at]), np.searchsorted(offsets, bounds[:-1], "right") - 1
    full = np.diff(at) > 0
    per_line = np.concatenate([[0], np.cumsum(np.bincount(line_row[full], minlength=n)[:n])])
    own_lines = np.maximum(np.diff(per_line), 1)
    more = np.column_stack(
        [
            np.log1p(n_words),
            mean / 10,
            spread / 10,
            np.sqrt(_per_row(first, (size > 25)) / per),
            np.sqrt(_per_row(first, upper(head) & upper(second) & (size > 1)) / per),
            np.sqrt(_per_row(first, ~letter(head)) / per),
            np.sqrt(_per_row(first, ~letter(tail)) / per),
            np.sqrt(_per_row(first, (size == 1)) / per),
            1 - _distinct(first, words.hashes) / per,
            np.log1p(n_lines),
            np.log1p(n_words / n_lines),
            1 - _distinct(per_line, line_hash[full]) / own_lines,
            np.log1p(lengths),
            (n_words == 0).astype(float),
        ]
    )
    word_rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(first))
    hashed = np.bincount(word_rows * _HASHED + (words.hashes >> np.uint64(58)).astype(np.int64), minlength=n * _HASHED).reshape(n, _HASHED)
    return np.column_stack([np.sqrt(shares), more, np.sqrt(hashed / per[:, None])])


def _all_features(column) -> np.ndarray:
    data, offsets = text_buffers(column)
    return np.concatenate([np.zeros((0, N_FEATURES)), *(features(Words(data, offsets[a : b + 1])) for a, b in chunks(data, offsets))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    center: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(gradient, size: int, steps: int, rate: float, start: np.ndarray | None = None) -> np.ndarray:
    w = np.zeros(size) if start is None else start
    m, v = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        grad = gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _prepared(x: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.clip((x - center) / scale, -8, 8), np.ones(len(x))])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, l2: float = 1e-2, delta: float = 0.1, seed: int = 3) -> float:
    """The share of positives among ``unlabelled``: the score of a classifier of one against the other is cut where the ratio of
    the shares above the cut, with the margins of both samples added, is least. Labels of the unlabelled play no part.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    center, scale = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3)
    halves = lambda x, s: np.array_split(_prepared(x, center, scale)[np.random.RandomState(s).permutation(len(x))], 2)
    (p, p_test), (u, u_test) = halves(positive, seed), halves(unlabelled, seed + 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        g = p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u)
        g[:-1] += l2 * w[:-1]
        return g

    w = _adam(gradient, p.shape[1], steps, rate)
    ps, us = np.sort(p_test @ w), np.sort(u_test @ w)
    cuts = np.unique(ps)
    above_p = 1 - np.searchsorted(ps, cuts) / len(ps)
    above_u = 1 - np.searchsorted(us, cuts) / len(us)
    margin = np.sqrt(np.log(4 / delta) / 2) * (len(ps) ** -0.5 + len(us) ** -0.5)
    best = int(np.argmin((above_u + margin) / above_p))
    return float(min(max(above_u[best] / above_p[best], 0.01), 0.99))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; without positives or unlabelled rows the score is the prior."""
    prior = min(max(prior, 0.01), 0.99)
    everything = unlabelled if len(unlabelled) else np.zeros((1, N_FEATURES))
    center, scale = everything.mean(axis=0), np.maximum(everything.std(axis=0), 1e-3)
    model = Model(np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))), center, scale, prior)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = _prepared(positive, center, scale), _prepared(unlabelled, center, scale)
    loss = lambda z: np.logaddexp(0, -z)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        below = loss(-zu).mean() - prior * loss(-zp).mean() < 0
        g = -negative if below else prior * (p.T @ (sp - 1)) / len(p) + negative
        g[:-1] += l2 * w[:-1]
        return g

    w = _adam(gradient, p.shape[1], steps, rate, np.append(model.weights, model.bias))
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def _emit_features(batches):
    for batch in batches:
        x = _all_features(batch.column("_text")).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([flat], names=["x"])


def _collect(rows: DataFrame) -> np.ndarray:
    table = rows.select("_text").mapInArrow(_emit_features, "x array<float>").toArrow()
    return np.asarray(table.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES).astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, held_out: int = 1, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows whose crc32(id) modulo ``folds`` isn't ``held_out``: about ``positives`` trusted positives and
    ``unlabelled`` texts whose labels aren't looked at; from these two the class prior is estimated too.
    An id with several labels counts with the least, and with its least text; repeated rows count once; null ids and
    null labels are not used. Without positives the score is 0.5 throughout.
    """
    spark = docs.sparkSession
    send_package(spark)
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).where("_id is not null")
    own = own.where(fold(F.col("_id"), folds) != held_out)
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("_label")).where("_id is not null and _label is not null")
    known = known.where(fold(F.col("_id"), folds) != held_out).groupBy("_id").agg(F.min("_label").alias("_label"))
    trusted = bounded(known.where("_label = 1").select("_id"), positives, salt=21)
    found = own.join(trusted, "_id", "left_semi").groupBy("_id").agg(F.min("_text").alias("_text"))
    positive, others = _collect(found), _collect(bounded(own, unlabelled, salt=22))
    return fit_nnpu(positive, others, estimate_prior(positive, others))


def _score(model: Model, within: str | None):
    def run(batches):
        for batch in batches:
            score = model.score(_all_features(batch.column("_row").field(within) if within else batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(score)], names=["_row", "score"])
            give_back()

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", folds: int = 3, held_out: int = 1, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``) and held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts are scored like any other, repeated rows as often as they come; an empty table gives an
    empty one. Columns that are named like a result are replaced.
    """
    send_package(docs.sparkSession)
    rows, carried = with_text(docs, {"held_out", "score", "predicted"}, text, keep_text)
    out = rows.mapInArrow(_score(model, text if keep_text else None), T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("score", T.DoubleType())]))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in carried],
        (fold(F.col("_row").getField(id_col), folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
