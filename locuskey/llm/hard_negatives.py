"""Hard negatives: for each anchor its nearest rows of its label, and for each of these the hardest rows of other labels within bounds.

Vectors get one more component that makes all lengths equal, so that the greatest inner product is the least distance. A vector's key is
(nearest pivot, distance to it); vectors are stored sorted by that key, in blocks, and each pivot's part of a stored partition is an interval of keys. For
a query at distance d from a pivot a row at distance k is |d - k| away at least, so the intervals round d hold the near rows. A round scans some intervals more, those that
may hold the best scores, and a query ends when what no unscanned interval can hold is better than its k-th best. Queries go in packs: a pack meets a block in one product
of matrices.

Queries are dealt to tasks. A task takes its packs through all rounds of both searches and reads the stored blocks itself, one after the other, so no pack is sent to a
block, no round is a job, and neither the driver nor a shuffle holds anything that grows with packs times blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskey.llm.scratch import Tables, blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import give_back

#: Rows that pivots are fitted to; all rows are stored and searched.
SAMPLE = 4096
PIVOTS = 32
#: Rows of a stored block, and queries of a pack.
BLOCK, PACK = 1024, 128
#: Stored partitions at most, each with an interval for every pivot in it: this bounds the list of intervals, PIVOTS more, and the driver's sample of keys.
PARTITIONS = 1 << 11
#: Queries that a task takes through the blocks at once, and blocks that it reads at once.
TOGETHER, READ = 1 << 13, 16
#: Intervals that a pack's first round scans; each further round scans so many times more.
FIRST, MORE = 16, 4
#: Rows whose squared length reaches this have no 64-bit scores.
_LONGEST = 2.0**62
_NONE = -(2**63)


@dataclass(frozen=True)
class _Space:
    """What all tasks know: sizes, pivots, and the intervals in order of their numbers."""

    dim: int
    longest: int
    pivots: np.ndarray
    name: np.ndarray | None = None
    pivot: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    #: Where the blocks are stored, and in which of the files each interval is.
    folder: str = ""
    files: list[list[str]] | None = None
    first: int = FIRST
    more: int = MORE

    @property
    def work(self) -> type:
        """Numbers in which inner products are exact: every partial sum is at most the squared length."""
        return np.float32 if self.longest < 1 << 24 else np.float64 if self.longest < 1 << 53 else np.int64

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """To each pivot, of vectors with their further component."""
        full = np.column_stack([x.astype(np.float64), extra])
        square = (full**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def extra(self, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - norm, 0))


def _vectors(batch: pa.RecordBatch, scale: float):
    """(places of the rows that take part, their components after each other, where each begins, squared lengths)."""
    column = batch.column("x")
    values = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    begin = np.cumsum(size) - size
    whole = np.floor(scale * values)
    row = np.repeat(np.arange(len(size)), size)
    norm = np.bincount(row, np.where(np.isfinite(whole), whole, 0) ** 2, minlength=len(size))
    bad = np.bincount(row, ~np.isfinite(values), minlength=len(size)) > 0
    known = np.ones(len(size), bool)
    for c in ("id", "label", "x"):
        known &= np.asarray(batch.column(c).is_valid())
    return np.flatnonzero(known & ~bad & (norm < _LONGEST)), whole, begin, size, norm


def _measure(scale: float):
    def run(batches):
        for batch in batches:
            rows, _, _, size, norm = _vectors(batch, scale)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([int(size[rows].max())], pa.int64()), pa.array([float(norm[rows].max())])], names=["n", "dim", "longest"])

    return run


def _dense(whole: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    out = np.zeros((len(rows), dim), np.int64)
    inside = np.arange(dim) < size[rows][:, None]
    out[inside] = whole[(begin[rows][:, None] + np.arange(dim))[inside]].astype(np.int64)
    return out


def _packed(x: np.ndarray) -> bytes:
    """Vectors in 16 bits a component where they fit."""
    return (x.astype("<i2") if not x.size or (x.min() >= -32768 and x.max() < 32768) else x.astype("<i8")).tobytes()


def _unpacked(blob: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(blob, "<i2" if len(blob) == 2 * rows * dim else "<i8").reshape(rows, dim)


_KEYED = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("pivot", pa.int32()), ("distance", pa.float64()), ("x", pa.binary())])
_KEYED_DDL = "id long, label long, anchor boolean, pivot int, distance double, x binary"


def _assign(space: _Space, scale: float):
    def run(batches):
        for batch in batches:
            rows, whole, begin, size, norm = _vectors(batch, scale)
            for a in range(0, len(rows), BLOCK):
                part = rows[a : a + BLOCK]
                x = _dense(whole, begin, size, part, space.dim)
                d = space.distances(x, space.extra(norm[part]))
                near = d.argmin(1)
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("label").take(take), batch.column("anchor").take(take), pa.array(near, pa.int32()), pa.array(d[np.arange(len(part)), near]), pa.array([_packed(v) for v in x], pa.binary())], schema=_KEYED
                )

    return run


def _runs(batches, most: int, dim: int, one_pivot: bool):
    """Sorted rows in lots of at most ``most``; a row that repeats another in all it has counts once."""
    held, last = [], None

    def lot():
        ids, labels, pivots, distances, xs = zip(*held, strict=True)
        wide = np.array([np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<i8") for x in xs]).reshape(len(xs), dim)
        return np.array(ids, np.int64), np.array(labels, np.int64), pivots[0], np.array(distances), wide

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "pivot", "distance", "x")), strict=True):
            if row == last:
                continue
            if held and (len(held) == most or (one_pivot and row[2] != held[0][2])):
                yield lot()
                held = []
            held.append(row)
            last = row
    if held:
        yield lot()


def _store(dim: int):
    """Blocks of sorted rows: an interval's number (partition and pivot), its distances, ids, labels and vectors."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for ids, labels, pivot, distance, x in _runs(batches, BLOCK, dim, True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part * PIVOTS + pivot], pa.int64()), pa.array([pivot], pa.int32()), pa.array([float(distance.min())]), pa.array([float(distance.max())]), pa.array([ids.tobytes()]), pa.array([labels.tobytes()]), pa.array([_packed(x)])],
                names=["interval", "pivot", "least", "most", "ids", "labels", "xs"],
            )
        give_back()

    return run


class _Pack:
    """A pack of queries with its slots."""

    def __init__(self, ids, labels, x, low, high, best, positives=None, positive_scores=None):
        self.ids, self.labels, self.x, self.low, self.high, self.best = ids, labels, x, low, high, best
        self.scores = np.full((*low.shape, best), _NONE, np.int64)
        self.found = np.zeros((*low.shape, best), np.int64)
        self.positives, self.positive_scores = positives, positive_scores
        self.scanned = None
        self.held: list[tuple] = []

    def settle(self) -> None:
        """Takes in what scans have found."""
        if self.held:
            self.take(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held = []

    def take(self, place: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Adds found rows, place being query * slots + slot, and keeps the best."""
        n, s, k = self.scores.shape
        old = np.flatnonzero(self.scores.ravel() != _NONE)
        place = np.concatenate([old // k, place])
        score, id_ = np.concatenate([self.scores.ravel()[old], score]), np.concatenate([self.found.ravel()[old], id_])
        order = np.lexsort([id_, -score, place])
        place, score, id_ = place[order], score[order], id_[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        ok = rank < k
        self.scores = np.full(n * s * k, _NONE, np.int64)
        self.found = np.zeros(n * s * k, np.int64)
        at = place[ok] * k + rank[ok]
        self.scores[at], self.found[at] = score[ok], id_[ok]
        self.scores, self.found = self.scores.reshape(n, s, k), self.found.reshape(n, s, k)

    def least(self) -> np.ndarray:
        """The lowest score that a row must have to be taken, for each query and slot."""
        return np.maximum(self.scores[:, :, -1], self.low)

    def choose(self, space: _Space) -> list[int]:
        """The numbers of the intervals to scan next, marked as scanned: those that may hold the best scores first. None are left when every slot's best are certain."""
        n = len(space.name)
        scanned = self.scanned if self.scanned is not None else np.zeros(n, bool)
        norm = (self.x.astype(np.float64) ** 2).sum(1)
        d = space.distances(self.x, np.zeros(len(self.ids)))
        slack = 1e-6 * np.sqrt(space.longest) + 1e-9
        promise = np.full(n, -np.inf)
        least, high = self.least().astype(np.float64), self.high.astype(np.float64)
        for q in range(len(self.ids)):
            own = d[q][space.pivot]
            near = np.maximum(np.maximum(own - space.most, space.least - own) - slack, 0)
            far = own + space.most + slack
            # Twice an inner product is both squared lengths less the squared distance.
            top = (space.longest + norm[q] - near**2) / 2 * (1 + 1e-12) + 1e-6 + 1e-9 * space.longest
            bottom = (space.longest + norm[q] - far**2) / 2 - 1e-6 - 1e-9 * space.longest
            for s in range(self.low.shape[1]):
                if self.low[q, s] <= self.high[q, s]:
                    may = (top >= least[q, s]) & (bottom <= high[q, s])
                    promise = np.where(may, np.maximum(promise, np.minimum(top, high[q, s])), promise)
        promise[scanned] = -np.inf
        left = np.flatnonzero(promise > -np.inf)
        rounds = space.first if not scanned.any() else space.more * int(scanned.sum())
        pick = left[np.lexsort([left, -promise[left]])[:rounds]]
        scanned[pick] = True
        self.scanned = scanned
        return pick.tolist()

    def scan(self, space: _Space, same: bool, own: np.ndarray, kinds: np.ndarray, x: np.ndarray) -> None:
        """Holds what a block has that may be among the best of the slots."""
        score = self.x.astype(space.work) @ x.T
        apt = None
        k = self.best
        least = self.least().astype(space.work)
        high = self.high.astype(space.work)
        for s in range(self.low.shape[1]):
            ok = (score >= least[:, s : s + 1]) & (score <= high[:, s : s + 1])
            many = np.count_nonzero(ok)
            if not many:
                continue
            if many > k * len(ok):
                if apt is None:
                    apt = ((self.labels[:, None] == kinds) == same) & (self.ids[:, None] != own)
                ok &= apt
                if len(own) > k:
                    edge = np.partition(np.where(ok, score, space.work(-space.longest - 1)), len(own) - k, axis=1)[:, len(own) - k]
                    ok &= score >= edge[:, None]
            row, at = np.nonzero(ok)
            fit = ((self.labels[row] == kinds[at]) == same) & (self.ids[row] != own[at])
            row, at = row[fit], at[fit]
            if len(row):
                self.held.append((row * self.low.shape[1] + s, score[row, at].astype(np.int64), own[at]))
        # Taken in before they are many: the lowest score that counts rises with each.
        if sum(len(h[0]) for h in self.held) > k * self.low.size // 4:
            self.settle()

    def further(self, best: int, low: tuple[int, int], high: tuple[int, int]) -> _Pack:
        """The same queries, with a slot for each positive that bounds the negatives' scores."""
        positive, score = self.found[:, 0, :], self.scores[:, 0, :]
        exact = score.astype(object)
        there = score != _NONE
        bottom = np.where(there, -(-low[0] * exact // low[1]), 1).astype(np.int64)
        top = np.where(there, high[0] * exact // high[1], 0).astype(np.int64)
        return _Pack(self.ids, self.labels, self.x, bottom, top, best, positive, score)


def _packed_queries(dim: int):
    """Packs of sorted anchors."""

    def run(batches):
        for ids, labels, _, _, x in _runs(batches, PACK, dim, False):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([labels.tobytes()]), pa.array([_packed(x)])], names=["ids", "labels", "xs"])

    return run


def _search(packs: list[_Pack], space: _Space, same: bool) -> None:
    """Rounds of scans until no pack has an interval left that could better its slots."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(space.folder)
    while True:
        wanted: dict[int, list[_Pack]] = {}
        for pack in packs:
            for i in pack.choose(space):
                wanted.setdefault(int(space.name[i]), []).append(pack)
        if not wanted:
            return
        for name in sorted({f for n, own in zip(space.name.tolist(), space.files, strict=True) if n in wanted for f in own}):
            with store.open_input_file(f"{top}/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(READ, columns=["interval", "ids", "labels", "xs"], use_threads=False):
                    for i, interval in enumerate(batch.column("interval").to_pylist()):
                        if interval in wanted:
                            own, kinds = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "labels"))
                            x = _unpacked(batch.column("xs")[i].as_buffer(), len(own), space.dim).astype(space.work)
                            for pack in wanted[interval]:
                                pack.scan(space, same, own, kinds, x)
        for pack in packs:
            pack.settle()


def _find(space: _Space, positives: int, negatives: int, low: tuple[int, int], high: tuple[int, int]):
    """A task's packs through both searches: the best rows of their own label, then those of other labels within the bounds that the first set."""

    def answers(packs: list[_Pack]):
        _search(packs, space, True)
        packs = [p.further(negatives, low, high) for p in packs]
        _search(packs, space, False)
        for p in packs:
            q, s, rank = np.nonzero(p.scores != _NONE)
            columns = [p.ids[q], p.positives[q, s], rank + 1, p.found[q, s, rank], p.positive_scores[q, s], p.scores[q, s, rank]]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    def run(batches):
        packs = []
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                shape = (len(ids), 1)
                packs.append(_Pack(ids, labels, _unpacked(r["xs"], len(ids), space.dim), np.full(shape, _NONE), np.full(shape, -_NONE - 1), positives))
                if len(packs) * PACK >= TOGETHER:
                    yield from answers(packs)
                    packs = []
        if packs:
            yield from answers(packs)
        give_back()

    return run


def _pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Means of groups of the sample, begun at rows that lie apart."""
    r = np.random.RandomState(11)
    centres = x[[r.randint(len(x))]]
    gap = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < count and gap.max() > 0:
        centres = np.vstack([centres, x[r.choice(len(x), p=gap / gap.sum())]])
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(4):
        near = ((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for i in np.unique(near):
            centres[i] = x[near == i].mean(0)
    return centres


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: float = 256.0, id_col: str = "vec_id", label: str | Column = "label", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score), exact.

    A vector's components become floor(``scale`` * x); scores are integer inner products, higher first, ties by the smaller id. An anchor is a row for which ``anchor`` holds; its positives
    are its first ``positives`` other rows of its label. For each, the first ``negatives`` rows of other labels are returned whose score lies between ``low`` and ``high`` (fractions) times
    the positive's, both included: none for a negative positive's score. Fewer are returned where there are fewer; an anchor without a positive or without negatives has no rows.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows whose squared length after scaling reaches 2**62. Shorter vectors
    count as followed by zeros. Rows that repeat id, label and vector count once; other rows of one id are rows of their own, but never each other's partners. Other columns are
    not read. Empty input gives no rows. Pivots are fitted to a bounded sample of ``SAMPLE`` rows; every row is stored and searched.
    """
    spark = vectors.sparkSession
    send_package(spark)
    tables = Tables(spark)
    kind = F.col(f"`{label}`") if isinstance(label, str) else label
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), kind.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    n, dim, longest = raw.mapInArrow(_measure(scale), "n long, dim long, longest double").agg(F.sum("n"), F.max("dim"), F.max("longest")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    dim = max(int(dim), 1)
    bare = _Space(dim, int(longest), np.zeros((1, dim + 1)))
    sample = raw.where("id is not null and label is not null and x is not null").orderBy(F.xxhash64("id", "x")).limit(SAMPLE).coalesce(1).mapInArrow(_assign(bare, scale), _KEYED_DDL).select("x").collect()
    x = np.array([_unpacked(r.x, 1, dim)[0] for r in sample], np.float64).reshape(-1, dim)
    if not len(x):
        x = np.zeros((1, dim))
    space = _Space(dim, int(longest), _pivots(np.column_stack([x, bare.extra((x**2).sum(1))]), min(pivots, PIVOTS)))
    keyed = tables.write(raw.mapInArrow(_assign(space, scale), _KEYED_DDL), "keyed")

    order = ["pivot", "distance", "id", "label", "x"]
    # Dealt by what is short: the driver samples the keys of ranges.
    dealt = order[:3]
    parts = min(tasks_for(blocks_for(keyed, BLOCK * 2 * dim * 4)), PARTITIONS)
    placed = keyed.select(*order).repartitionByRange(parts, *dealt).sortWithinPartitions(*order)
    blocks = tables.write(placed.mapInArrow(_store(dim), "interval long, pivot int, least double, most double, ids binary, labels binary, xs binary"), "blocks")
    listed = blocks.select("interval", "pivot", "least", "most", F.col("_metadata.file_name").alias("file")).groupBy("interval").agg(F.first("pivot"), F.min("least"), F.max("most"), F.collect_set("file")).orderBy("interval").collect()
    *columns, files = zip(*listed, strict=True)
    name, pivot, least, most = (np.array(c) for c in columns)
    space = _Space(dim, space.longest, space.pivots, name, pivot, least, most, tables.path_of(blocks), list(files), FIRST, MORE)

    asked = keyed.where("anchor").select(*order)
    n_asked = asked.count()
    ordered = asked.repartitionByRange(min(max(1, -(-n_asked // PACK)), PARTITIONS), *dealt).sortWithinPartitions(*order)
    packs = ordered.mapInArrow(_packed_queries(dim), "ids binary, labels binary, xs binary")
    # Each task reads the blocks once a round for so many queries.
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-n_asked // (cores * TOGETHER)))
    found = tables.write(packs.repartition(tasks).mapInArrow(_find(space, positives, negatives, low, high), empty.schema), "found")
    tables.drop(keyed, blocks)
    return found
