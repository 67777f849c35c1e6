"""Target-distribution importance resampling: documents are drawn by how much likelier their hashed n-grams are in a target.

Each task runs DuckDB over slices of its own rows: words are unnested, runs of words taken with windows, and each different run
hashed with zlib's CRC. A document's bucket counts and one row of sums for each task are written as Parquet; Spark merges the
sums, and scores documents from their counts. No text is shuffled. Ranks come from a range partitioning of the scores: a row's place in
its partition and the sizes of the partitions before it.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.llm.scratch import Tables, blocks_for, send_package, tasks_for
from locuskey.llm.textkernel import chunks, give_back, text_buffers

#: Bytes of text that DuckDB works on at once, a text more at most.
SLICE_BYTES = 2 << 20
#: Memory of a task's DuckDB; beyond that it spills into the task's temporary folder, which goes with it.
MEMORY = "512MB"
#: Bytes of scored rows in a partition of the ranking.
RANK_BYTES = 8 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc(column):
    """zlib's CRC of each string's UTF-8 bytes."""
    column = pa.chunked_array(column) if isinstance(column, list) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return pa.array([zlib.crc32(x) for x in column.cast(pa.binary()).to_pylist()], pa.uint32())


class _Counter:
    """Bucket counts of some texts, in DuckDB."""

    def __init__(self, words: int, buckets: int):
        import duckdb

        self.folder = tempfile.mkdtemp(prefix="locuskey-duckdb-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder})
        self.con.create_function("crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
        runs = " UNION ALL ".join(f"SELECT r, {' || chr(32) || '.join(['w', *(f'w{i}' for i in range(1, k))])} AS f FROM g" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, words + 1))
        further = "".join(f", lead(w, {i}) OVER (PARTITION BY r ORDER BY j) AS w{i}" for i in range(1, words))
        self.words = f"CREATE OR REPLACE TEMP TABLE t AS SELECT r, regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM texts"
        self.counts = f"""
            WITH u AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM t), g AS (SELECT r, w{further} FROM u), f AS MATERIALIZED ({runs}),
            d AS MATERIALIZED (SELECT f, crc32(f) % {buckets} AS b FROM (SELECT DISTINCT f FROM f))
            SELECT r, CAST(b AS INTEGER) AS b, CAST(count(*) AS BIGINT) AS n FROM f JOIN d USING (f) GROUP BY r, b ORDER BY r, b"""

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, and of each text and bucket in order: the text's place, the bucket, the count)."""
        self.con.register("texts", pa.table({"r": pa.array(np.arange(len(texts)), pa.int64()), "x": texts}))
        self.con.execute(self.words)
        n_words = self.con.execute("SELECT CAST(len(ws) AS BIGINT) AS n FROM t ORDER BY r").fetchnumpy()["n"]
        got = self.con.execute(self.counts).fetchnumpy()
        self.con.unregister("texts")
        return tuple(np.asarray(x) for x in (n_words, got["r"], got["b"], got["n"]))

    def close(self) -> None:
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _bucket_counts(words: int, buckets: int, rows: bool, kind: pa.DataType | None = None):
    """Rows (the input's row, words, buckets, counts), if wanted, and one row with the task's sums."""

    def run(batches):
        counter, total = _Counter(words, buckets), np.zeros(buckets, np.int64)
        try:
            for batch in batches:
                column = batch.column("_text")
                _, offsets = text_buffers(column)
                for a, b in chunks(np.zeros(0, np.uint8), offsets, SLICE_BYTES):
                    part = column.slice(a, b - a)
                    n_words, r, bucket, n = counter.count(part.fill_null("") if part.null_count else part)
                    np.add.at(total, bucket, n)
                    if rows:
                        edges = pa.array(np.searchsorted(r, np.arange(b - a + 1)), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("_row").slice(a, b - a), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(n, pa.int64())), pa.nulls(b - a, pa.list_(pa.int64()))],
                            names=["_row", "_words", "_buckets", "_counts", "_total"],
                        )
            sums = pa.array([total.tolist()], pa.list_(pa.int64()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())), sums], names=["_row", "_words", "_buckets", "_counts", "_total"])
            else:
                yield pa.RecordBatch.from_arrays([sums], names=["_total"])
        finally:
            counter.close()
            give_back()

    return run


def _merged(sums: DataFrame, buckets: int) -> np.ndarray:
    """All counts by bucket: one row for each bucket comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for b, n in sums.where("_total is not null").select(F.posexplode("_total").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[b] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket."""
    t, s, buckets = int(target.sum()), int(source.sum()), len(target)
    return np.array([math.floor(1000 * math.log(float(x + 1) * float(s + buckets) / (float(y + 1) * float(t + buckets)))) for x, y in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            buckets, counts = batch.column("_buckets"), batch.column("_counts")
            edges = np.concatenate([[0], np.cumsum(np.diff(np.asarray(buckets.offsets)))])
            n = np.asarray(counts.flatten())
            sums = np.concatenate([[0], np.cumsum(gain[np.asarray(buckets.flatten())] * n)])
            whole = np.concatenate([[0], np.cumsum(n)])
            features = whole[edges[1:]] - whole[edges[:-1]]
            weight = (sums[edges[1:]] - sums[edges[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_words"), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], names=["_row", "_words", "_features", "_weight"])

    return run


def noise(id_, seed: int) -> F.Column:
    """floor(1000 * a Gumbel variate) that an id alone decides: the first 8 hex digits of sha256(``<seed>:<id>``) are its uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, words: int = 2, buckets: int = 10000, seed: int = 7, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and n_words, n_features, weight, score, rank (all long), a row for each row.

    A feature is a run of 1 to ``words`` consecutive words, lower-cased in A-Z; its bucket is the CRC of its bytes modulo ``buckets``. A weight
    is the floored mean of its features' gains, the log ratio of target to source, in thousandths; the score adds Gumbel noise decided by the id, so
    that the highest scores are a draw without replacement. Of the N rows with ``least_words`` words the floor(``percent`` * N / 100) with the highest
    scores are drawn, ties to the smaller id (nulls last), and have rank 1, 2, 3..; other ranks are null. Counts are taken over
    all rows and all of each text. Null and empty texts have no features and weight 0; a null id counts as the empty text in the noise; rows that repeat
    an id are rows of their own, each with a rank. An empty target has even shares; empty ``docs`` give no rows. Of columns named like a result,
    the result is returned.
    """
    spark = docs.sparkSession
    send_package(spark)
    tables = Tables(spark)
    new = ["n_words", "n_features", "weight", "score", "rank"]
    carried = [c for c in docs.columns if c != text]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), F.struct(F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in carried] or [F.lit(None).alias("_none")]).alias("row")).alias("_row"))
    kind = _arrow_type(rows.schema["_row"])
    out = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), T.StructField("_words", T.LongType()), T.StructField("_buckets", T.ArrayType(T.IntegerType())), T.StructField("_counts", T.ArrayType(T.LongType())), T.StructField("_total", T.ArrayType(T.LongType()))])
    counted = tables.write(rows.mapInArrow(_bucket_counts(words, buckets, True, kind), out), "bucket-counts")
    wanted = target.select(F.col(f"`{target_text}`").cast("string").alias("_text")).mapInArrow(_bucket_counts(words, buckets, False), "_total array<long>")
    gain = gains(_merged(wanted, buckets), _merged(counted, buckets))

    weighed = counted.where("_row is not null").select("_row", "_words", "_buckets", "_counts")
    weighed = weighed.mapInArrow(_weigh(gain), T.StructType([T.StructField("_row", rows.schema["_row"].dataType), *(T.StructField(c, T.LongType()) for c in ("_words", "_features", "_weight"))]))
    score = F.col("_weight") + noise(F.col("_row.id"), seed)
    scored = tables.write(weighed.withColumn("_score", score), "scores")
    tables.drop(counted)
    able = F.col("_words") >= least_words
    n = scored.where(able).count()
    draw = percent * n // 100
    parts = tasks_for(blocks_for(scored, RANK_BYTES))
    ordered = scored.where(able).repartitionByRange(parts, F.desc("_score"), F.asc_nulls_last("_row.id")).sortWithinPartitions(F.desc("_score"), F.asc_nulls_last("_row.id"))
    # The lower 33 bits of this number are a row's place in its partition.
    placed = tables.write(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = dict(placed.groupBy("_part").count().collect())
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append((p, total))
        total += sizes.get(p, 0)
    starts = spark.createDataFrame(before, "_part int, _before long")
    ranked = placed.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_before") + F.col("_place") + 1)
    every = ranked.withColumn("_rank", F.when(F.col("_rank") <= draw, F.col("_rank"))).drop("_part", "_place", "_before").unionByName(scored.where(~able).withColumn("_rank", F.lit(None).cast("long")))
    own = [F.col("_row.row").getField(c).alias(c) for c in carried if c not in new]
    return every.select(*own, F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


def _arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
