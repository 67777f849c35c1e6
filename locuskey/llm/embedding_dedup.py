"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosines.

Equal vectors are one class with a multiplicity. Each class gets one bucket per table: quantised
Gaussian projections. Buckets are cut into tiles of bounded size, tiles are dealt over lots, and a
lot multiplies its vectors in double precision. A pair counts in the first table in which it shares
a bucket, so links are counted once without listing pairs; a tile returns a count and one edge for
each vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskey.llm.components import components
from locuskey.llm.scratch import Tables, send_package

WIDTH = 1.2
#: Vectors that share a bucket by chance, about.
CROWD = 32
TILE = 1024
LOT_ROWS = 4096


def same_bucket(distance: float, width: float) -> float:
    """Probability that one quantised Gaussian projection agrees for two points at that distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, cosine: float, recall: float, width: float = WIDTH) -> tuple[int, int]:
    """(projections per table, tables): unrelated vectors share buckets with about CROWD others; pairs at the threshold are missed by 1 - recall."""
    k = max(1, math.ceil(math.log(max(n / CROWD, 2)) / -math.log(same_bucket(math.sqrt(2), width))))
    hit = same_bucket(math.sqrt(2 - 2 * cosine), width) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    v = flat.reshape(-1, dim).astype(np.float64)
    # Scaled first, so that neither very large nor very small components overflow when squared.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets


def _signatures(k: int, tables: int, width: float, seed: int):
    def run(batches):
        planes = {}
        for batch in batches:
            flat, offsets = _lists(batch.column("vector"))
            dims = np.diff(offsets)
            out = np.zeros((len(dims), tables), np.int32)
            for dim in np.unique(dims):
                if dim not in planes:
                    made = np.random.RandomState(seed + int(dim))
                    planes[dim] = made.standard_normal((dim, k * tables)), made.uniform(0, width, k * tables), made.randint(1, 2**62, k, dtype=np.int64) | 1
                a, b, mix = planes[dim]
                rows = np.flatnonzero(dims == dim)
                unit = _unit(flat[(offsets[rows][:, None] + np.arange(dim)).ravel()], int(dim))
                cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(rows), tables, k)
                code = (cells * mix).sum(axis=2) + int(dim) * 0x632BE59BD9B4E019 % 2**63
                out[rows] = (code >> 31).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("copies"), batch.column("vector"), lists], names=["class", "copies", "vector", "buckets"])

    return run


def _tiles(cosine: float):
    def run(key, table):
        table = table.combine_chunks()
        names = np.array(table.column("class").to_pylist(), object)
        copies = np.asarray(table.column("copies"))
        spot = [np.asarray(table.column(c)) for c in ("t", "bucket", "i", "j")]
        sides = [np.asarray(table.column(c).cast(pa.int8())).astype(bool) for c in ("left", "right")]
        flat, offsets = _lists(table.column("vector").combine_chunks())
        dims = np.diff(offsets)
        codes, c_offsets = _lists(table.column("buckets").combine_chunks())
        codes = codes[c_offsets[0] : c_offsets[-1]].reshape(len(names), -1)
        order = np.lexsort(spot[::-1])
        change = np.zeros(len(order) - 1, bool)
        for s in spot:
            change |= np.diff(s[order]) != 0
        out_class, out_links, out_root = [], [], []
        for tile in np.split(order, np.flatnonzero(change) + 1):
            dim = dims[tile[0]]
            tile = tile[dims[tile] == dim]
            lefts, rights = tile[sides[0][tile]], tile[sides[1][tile]]
            if not len(lefts) or not len(rights):
                continue
            at = lambda rows: _unit(flat[(offsets[rows][:, None] + np.arange(dim)).ravel()], int(dim))  # noqa: B023, E731
            linked = at(lefts) @ at(rights).T >= cosine
            linked &= lefts[:, None] != rights[None, :]
            t, i, j = spot[0][tile[0]], spot[2][tile[0]], spot[3][tile[0]]
            for before in range(t):
                linked &= codes[lefts, before][:, None] != codes[rights, before][None, :]
            if not linked.any():
                continue
            both = np.union1d(lefts, rights)
            l, r = np.searchsorted(both, lefts), np.searchsorted(both, rights)
            links = np.zeros(len(both), np.int64)
            links[l] += linked @ copies[rights]
            if i != j:
                links[r] += linked.T @ copies[lefts]
            label = np.arange(len(both))
            while True:
                new = label.copy()
                np.minimum.at(new, l, np.where(linked, label[r][None, :], len(both)).min(axis=1))
                np.minimum.at(new, r, np.where(linked, label[l][:, None], len(both)).min(axis=0))
                if (new == label).all():
                    break
                label = new
            has = np.flatnonzero(links)
            out_class += names[both[has]].tolist()
            out_links += links[has].tolist()
            out_root += names[both[label[has]]].tolist()
        return pa.table({"class": pa.array(out_class, pa.string()), "links": pa.array(out_links, pa.int64()), "other": pa.array(out_root, pa.string())})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, recall: float = 0.99, width: float = WIDTH, tile: int = TILE, seed: int = 7) -> DataFrame:
    """Per row of ``vectors``: its id, n_links (other rows linked directly), component_id (least id reachable), kept (id = component_id).

    Rows link when their cosine in double precision is ``cosine`` or more; the pairs tested are those
    that share a bucket in one of the tables, so a pair at the threshold itself is found with probability
    ``recall`` and a closer one with a higher one. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing, and vectors of different length never link. Equal rows link
    with each other. A null id is no component's id while another is to be had. Other columns are not returned.
    """
    spark = vectors.sparkSession
    send_package(spark)
    tables = Tables(spark)
    v = F.col("vector")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.withColumn("vector", F.when(F.coalesce(sound, F.lit(False)), v))
    rows = rows.withColumn("class", F.when(v.isNotNull(), F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), v)), 16, "0") for s in (1, 2)])))
    ids = rows.select("_id", "class")
    classes = tables.write(rows.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.first("vector").alias("vector")), "vectors")
    n = classes.count()
    k, n_tables = tables_for(n, cosine, recall, width)
    element = rows.schema["vector"].dataType.simpleString()
    hashed = tables.write(classes.mapInArrow(_signatures(k, n_tables, width, seed), f"class string, copies long, vector {element}, buckets array<int>"), "hashed")
    spots = hashed.select("class", F.posexplode("buckets").alias("t", "bucket"))
    crowded = spots.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    cells = spots.join(crowded, ["t", "bucket"]).withColumn("n", F.ceil(F.col("size") / tile).cast("int")).withColumn("at", F.pmod(F.xxhash64("class", F.lit(5)), F.col("n")).cast("int"))
    # Tile (i, j) with i <= j holds part i on its left and part j on its right side.
    left = cells.select("class", "t", "bucket", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("n") - 1)).alias("j"), F.lit(True).alias("left"), (F.col("n") < 0).alias("right"))
    right = cells.select("class", "t", "bucket", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    spot = ["t", "bucket", "i", "j"]
    placed = tables.write(left.unionByName(right).groupBy("class", *spot).agg(F.max("left").alias("left"), F.max("right").alias("right")), "tiles")
    lots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // LOT_ROWS))
    full = placed.join(hashed, "class").withColumn("_lot", F.pmod(F.xxhash64(*spot), F.lit(lots)))
    found = tables.write(full.groupBy("_lot").applyInArrow(_tiles(cosine), "class string, links long, other string"), "links")
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")), tables)
    firsts = ids.where("class is not null").groupBy("class").agg(F.min("_id").alias("_first"), F.count("*").alias("copies"))
    joined = firsts.join(counts, "class", "left").join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    joined = tables.write(joined.select("class", "_first", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classed")
    least = joined.groupBy("root").agg(F.min("_first").alias("component_id"))
    out = ids.join(joined.join(least, "root").select("class", "n_links", "component_id"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
