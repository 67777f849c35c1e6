"""Tables in the folder that driver and executors share, and sizes taken from plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimates from this size on are no estimates.
_UNKNOWN = 1 << 52


def folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, as in tests, a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="locuskey-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(_forget, base.removeprefix("file://"))
    return base.rstrip("/")


def _forget(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/locuskey-{name}-{uuid.uuid4().hex}"


class Tables:
    """Written tables of one operator call; ``drop`` removes those that no later read needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        path = new_path(self.spark, name)
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def path_of(self, table: DataFrame) -> str:
        return self.paths[id(table)][0]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t))
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size: that of the files for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def blocks_for(df: DataFrame, block_bytes: int) -> int:
    """A block count that grows with the input, two for each shuffle partition at least.

    Where Spark does not know a frame's size, as of rows from the driver or from a join, its texts are measured.
    """
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    if size >= _UNKNOWN:
        texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        size = sum(df.agg(*texts).first()) if texts else 0
    return int(max(least, -(-size // block_bytes)))


def tasks_for(groups: int) -> int:
    """Shuffle partitions for so many groups: one each, up to a number that a driver can keep account of; a task then has several groups in turn."""
    return min(groups, 1 << 15)


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Let executors import this package also where it isn't installed."""
    import os
    import zipfile

    import locuskey

    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    top = os.path.dirname(os.path.abspath(locuskey.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="locuskey-zip-"), "locuskey_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("locuskey", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
