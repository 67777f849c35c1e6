"""Streaming: annotation of arriving lines, and repeatable ingest of arriving variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuskey.functions.assembly import Scheme
from locuskey.operators.annotate import annotate_lines
from locuskey.operators.collection import insert_or_ignore


def annotate_stream(spark: SparkSession, folder: str, scheme: Scheme, code: int, use_uuid: bool = False) -> DataFrame:
    """A stream of annotated data lines from text files that arrive in ``folder``."""
    lines = spark.readStream.text(folder).where("value <> '' and not startswith(value, '#')")
    return annotate_lines(lines, scheme, code, use_uuid)


#: Positions of a range of a stored stream: a genome has under 800 ranges.
RANGE_BITS = 22


def with_range(rows: DataFrame, lin: str = "lin") -> DataFrame:
    """``rows`` with the range of their position, by which ``ingest_stream`` stores them."""
    return rows.withColumn("range", F.shiftright(F.col(lin), RANGE_BITS).cast("int"))


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], by: str | None = None):
    """A stream writer that appends rows whose key isn't there yet; a batch that runs again appends nothing.

    ``by`` names a column that equal keys have in common and that has a bounded number of values, as ``with_range`` makes one: the store is
    partitioned by it, and a batch is compared with the partitions that it has rows for; the files of others are not read. Without it
    each batch reads the keys of the whole store.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        if by is None:
            have = spark.read.schema(batch.schema).parquet(path) if there else spark.createDataFrame([], batch.schema)
            insert_or_ignore(have, batch, keys, order).write.mode("append").parquet(path)
            return
        batch = batch.persist()
        try:
            ranges = [r[0] for r in batch.select(by).distinct().collect()]
            have = stored_ranges(spark, path, ranges, batch.schema, by) if there else spark.createDataFrame([], batch.schema)
            fresh = insert_or_ignore(have, batch, [by, *(k for k in keys if k != by)], order)
            fresh.repartition(by).write.mode("append").partitionBy(by).parquet(path)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def stored_ranges(spark: SparkSession, path: str, ranges: list, schema: T.StructType, by: str) -> DataFrame:
    """The stored rows of some ranges, or of none at all: a filter on the partitions."""
    known = [r for r in ranges if r is not None]
    wanted = F.col(by).isin(known) if known else F.lit(False)
    return spark.read.schema(schema).parquet(path).where(wanted | F.col(by).isNull() if None in ranges else wanted)
