"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Words are lower-cased letters between boundary marks; n-grams of one to three characters are hashed
into buckets. The regression is trained with follow-the-regularised-leader (per-coordinate rates,
elastic net) and its confidence is set by a temperature fitted on training rows it has not seen.
The logits are sums over n-grams divided by their number, so they are summed up once for each
different word of a chunk.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import send_package
from locuskey.llm.splits import fold, share_below, with_text
from locuskey.llm.textkernel import Words, chunks, give_back, text_buffers

#: Rows of a language that the fit uses at most, about.
PER_LANGUAGE = 1500
#: Languages that are learned at most: those with the most rows.
LANGUAGES = 256
BUCKETS = 1 << 16
_SCALE = 30.0
_POINTS = sys.maxunicode + 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_tables: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code point its lower-case form; 0 for what isn't a letter."""
    if not _tables:
        table = np.zeros(_POINTS, np.uint32)
        for i in range(_POINTS):
            if chr(i).isalpha():
                low = chr(i).lower()
                table[i] = ord(low[0])
        _tables.append(table)
    return _tables[0]


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of all n-grams of the texts, and whether each text has a letter."""
    joined = b" " + b" ".join(texts) + b" "
    points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t.decode("utf-8", "replace")) for t in texts], np.int64)
    owner = np.zeros(len(points), np.int32)
    owner[1:-1] = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)[: len(points) - 2] if len(texts) else 0
    c = _lower_letters()[points].astype(np.uint64)
    letter = c > 0
    one = np.flatnonzero(letter)
    owners, buckets = [owner[one]], [_bucket(c[one] * _MIX[0])]
    # Pairs with a letter in them, triples round a letter; 0 stands for a boundary.
    first = np.flatnonzero(letter[:-1] | letter[1:])
    owners.append(owner[np.where(letter[first], first, first + 1)])
    buckets.append(_bucket((c[first] * _MIX[0]) ^ (c[first + 1] * _MIX[1] + np.uint64(1))))
    middle = one[(one > 0) & (one < len(c) - 1)]
    owners.append(owner[middle])
    buckets.append(_bucket((c[middle - 1] * _MIX[0]) ^ (c[middle] * _MIX[1]) ^ (c[middle + 1] * _MIX[2] + np.uint64(2))))
    return np.concatenate(owners), np.concatenate(buckets), np.bincount(owner[one], minlength=len(texts)) > 0


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket by language; the inverse document frequencies are multiplied in
    bias: np.ndarray
    temperature: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and its probability for each text; ``und`` with 0.0 where there is no letter or nothing was learned."""
    tags: list[str] = []
    scores: list[float] = []
    k = len(model.languages)
    for a, b in chunks(data, offsets):
        words = Words(data, offsets[a : b + 1])
        n = b - a
        if not len(words.hashes) or not k:
            tags += ["und"] * n
            scores += [0.0] * n
            continue
        different, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        raw = words.bytes.tobytes()
        owner, bucket, letters = ngrams([raw[s:e] for s, e in zip(words.starts[sample].tolist(), words.ends[sample].tolist(), strict=True)])
        grams = np.bincount(owner, minlength=len(different)).astype(float)
        sums = np.column_stack([np.bincount(owner, weights=model.weights[bucket, i], minlength=len(different)) for i in range(k)])
        add = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[which])])[words.first])  # noqa: B023, E731
        total = add(grams)
        logits = np.column_stack([add(sums[:, i]) for i in range(k)]) / np.maximum(total, 1)[:, None] * _SCALE + model.bias
        p = model.probabilities(logits)
        best = p.argmax(axis=1)
        has = add(letters.astype(float)) > 0
        tags += [model.languages[i] if h else "und" for i, h in zip(best.tolist(), has.tolist(), strict=True)]
        scores += np.where(has, p[np.arange(n), best], 0.0).tolist()
    return tags, scores


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates for a softmax over sparse rows; l1 keeps weights at zero, l2 keeps them small."""

    def __init__(self, dim: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, target: int) -> None:
        w = self.weights(index)
        logits = value @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[target] -= 1
        g = value[:, None] * p[None, :]
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], epochs: int = 3, seed: int = 5) -> Model:
    """``rows``: (bucket, count, language) of each text. A fifth of them only sets the temperature."""
    k = len(languages)
    if k < 2 or not rows:
        return Model(languages, np.zeros((BUCKETS, k)), np.zeros(k), 1.0)
    order = np.random.RandomState(seed).permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    learn = [i for i in order.tolist() if i not in held]
    df = np.zeros(BUCKETS)
    for i in learn:
        df[rows[i][0]] += 1
    idf = np.log((1 + len(learn)) / (1 + df)) + 1
    vector = lambda b, c: (np.append(b, BUCKETS), np.append(c / c.sum() * idf[b] * _SCALE, 1.0))
    model = Ftrl(BUCKETS + 1, k)
    for _ in range(epochs):
        for i in learn:
            b, c, y = rows[i]
            model.learn(*vector(b, c), y)
    w = model.weights()
    out = Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], 1.0)
    if held:
        logits = np.array([v @ w[b] for b, v in (vector(rows[i][0], rows[i][1]) for i in held)])
        y = np.array([rows[i][2] for i in held])
        out.temperature = _temperature(logits, y)
    return out


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden section over its logarithm."""

    def nll(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        x1, x2 = high - r * (high - low), low + r * (high - low)
        low, high = (low, x2) if nll(x1) < nll(x2) else (x1, high)
    return float(np.exp((low + high) / 2))


def _emit(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("_text"))
        raw = data.tobytes()
        index, count = [], []
        for r in range(len(offsets) - 1):
            _, bucket, _ = ngrams([raw[offsets[r] : offsets[r + 1]]])
            i, c = np.unique(bucket, return_counts=True)
            index.append(i.astype(np.int32))
            count.append(c.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("_lang"), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], names=["_lang", "index", "count"])


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, most: int = LANGUAGES) -> Model:
    """A model from about ``per_language`` rows of each language, out of rows whose crc32(id) modulo ``folds`` isn't ``held_out``.

    Rows with a null id, text or language, or without letters, teach nothing, and repeated rows count once. Of more
    than ``most`` languages those with the most rows are learned (ties: the first by name). No rows give a model
    without languages.
    """
    send_package(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang"))
    own = own.where("_id is not null and _lang is not null").where(fold(F.col("_id"), folds) != held_out)
    counts = dict(own.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(most).collect())
    if not counts:
        return train([], [])
    shares = F.coalesce(F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language / n))])[F.col("_lang")], F.lit(0.0))
    table = own.where("_text is not null").where(share_below([F.col("_id"), F.col("_text")], shares, salt=31)).distinct().select("_lang", "_text").mapInArrow(_emit, "_lang string, index array<int>, count array<int>").toArrow()
    languages = sorted(counts)
    position = {x: i for i, x in enumerate(languages)}
    rows = []
    for part in table.to_batches():
        for j, language in enumerate(part.column("_lang").to_pylist()):
            index = np.asarray(part.column("index")[j].values).astype(np.int64)
            if len(index):
                rows.append((index, np.asarray(part.column("count")[j].values).astype(float), position[language]))
    # The order in which rows arrive must not matter.
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    return train(rows, languages)


def _label(model: Model, within: str | None):
    def run(batches):
        for batch in batches:
            texts = batch.column("_row").field(within) if within else batch.column("_text")
            tags, scores = predict(model, *text_buffers(texts))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(tags, pa.string()), pa.array(scores, pa.float64())], names=["_row", "lang_pred", "score"])
            give_back()

    return run


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", folds: int = 4, held_out: int = 2, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``) and held_out, lang_pred, score (the probability of lang_pred).

    A null text, and a text without a letter, is ``und`` with score 0; an empty table gives an empty one, and
    repeated rows are labelled as often as they come. Columns that are named like a result are replaced.
    """
    send_package(docs.sparkSession)
    new = {"held_out", "lang_pred", "score"}
    rows, carried = with_text(docs, new, text, keep_text)
    kind = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_label(model, text if keep_text else None), kind)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in carried], (fold(F.col("_row").getField(id_col), folds) == held_out).alias("held_out"), "lang_pred", "score")
