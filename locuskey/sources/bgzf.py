"""BGZF: gzip in blocks that can be cut and joined. Files of blocks read by several tasks, and files in the order of their lines written by several."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from locuskey.sources import package


def without_returns(value) -> Column:
    """A text without the carriage returns at its end; only one that has any is looked through."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.endswith("\r"), F.rtrim(v, F.lit("\r"))).otherwise(v)


#: Bytes of text in a block.
BLOCK = 0xFF00
# Fixed value: the empty block that ends a BGZF file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of text that a task cuts into lines, or packs into blocks, at once.
CHUNK = 1 << 20
#: Bytes of a file in a written part.
PART_BYTES = 64 << 20


def block(data: bytes) -> bytes:
    """One complete block of at most BLOCK bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))


# Reading.


def _size_at(data: bytes, at: int) -> int:
    """Where the block's size stands in the block that begins at ``at``; -1 if none begins there."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 12:
        return -1
    field, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while field + 4 <= min(end, len(data)):
        if data[field : field + 4] == b"BC\x02\x00":
            return field + 4
        field += 4 + struct.unpack_from("<H", data, field + 2)[0]
    return -1


def block_prefix(first: bytes) -> bytes | None:
    """What a file's blocks begin with, up to their sizes, by the file's first bytes; None if it isn't BGZF."""
    at = _size_at(first, 0)
    return first[:at] if at > 0 else None


def first_bytes(spark: SparkSession, path: str, n: int = 64) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        out = []
        while len(out) < n and (x := stream.read()) >= 0:
            out.append(x)
        return bytes(out)
    finally:
        stream.close()


def _raw_options(spark: SparkSession, path: str, prefix: bytes) -> dict[str, str] | None:
    """Reader options under which a file's bytes are cut at ``prefix`` and not unpacked; None where Hadoop would unpack them all the same.

    A name that ends in .gz has a codec, and files with a codec aren't cut. Hadoop takes the codec whose name's end sorts
    next before the file's, so one for a name's end that sorts between .gz and the file's stands in its way.
    """
    jvm = spark._jvm
    passing = jvm.org.apache.hadoop.io.compress.PassthroughCodec
    options = {"io.compression.codecs": passing.CLASSNAME, passing.OPT_EXTENSION: "!.gz"}
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for k, v in options.items():
        conf.set(k, v)
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(path)) is not None:
        return None
    return options | {"lineSep": prefix.decode("latin-1"), "encoding": "ISO-8859-1"}


def _members(prefix: bytes, record: bytes) -> Iterator[bytes]:
    """The blocks of what stood between two places at which the file was cut: one, or several if some begin otherwise than the first."""
    data, at = prefix + record, 0
    while at < len(data):
        spot = _size_at(data, at)
        end = at + struct.unpack_from("<H", data, spot)[0] + 1 if 0 < spot <= len(data) - 2 else 0
        if not at < end <= len(data):
            raise ValueError("a BGZF block is damaged or cut off")
        yield data[at:end]
        at = end


def _splits(batches, prefix: bytes) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(file, start, blocks) of each split that the task reads."""
    here, held = None, None

    def rows():
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_file", "block", "_data")), strict=True):
                yield row

    stream = rows()
    held = next(stream, None)

    def one():
        nonlocal held
        while held is not None and held[:2] == here:
            # Nothing stands before a file's first block.
            if held[2] or held[1]:
                yield from _members(prefix, held[2])
            held = next(stream, None)

    while held is not None:
        here = held[:2]
        members = one()
        yield *here, members
        for _ in members:
            pass


def _lines(prefix: bytes):
    """The lines that lie in one split from end to end, numbered from 1."""

    def run(batches):
        for file, start, members in _splits(batches, prefix):
            parts, size, number, begun = [], 0, 1, False

            def cut(data: bytes):
                nonlocal number
                found = pc.split_pattern(pa.array([data], pa.large_binary()), b"\n").flatten().cast(pa.binary())
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), found], names=["_file", "block", "row", "value"])
                number += n

            for member in members:
                text = zlib.decompress(member, 31)
                if not begun:
                    at = text.find(b"\n")
                    if at < 0:
                        continue
                    begun, text = True, text[at + 1 :]
                parts.append(text)
                size += len(text)
                if size >= CHUNK and (at := text.rfind(b"\n")) >= 0:
                    yield from cut(b"".join([*parts[:-1], text[:at]]))
                    parts, size = [text[at + 1 :]], len(text) - at - 1
            rest = b"".join(parts)
            if (at := rest.rfind(b"\n")) >= 0:
                yield from cut(rest[:at])

    return run


def _edges(prefix: bytes):
    """What a split has before its first and after its last line end: (row 0, does a line end behind it?), (row after all others, no). Only these blocks are unpacked."""

    def run(batches):
        for file, start, members in _splits(batches, prefix):
            members = list(members)
            head, lines, used = [], False, 0
            for used, member in enumerate(members, 1):  # noqa: B007
                text = zlib.decompress(member, 31)
                at = text.find(b"\n")
                head.append(text if at < 0 else text[:at])
                if at >= 0:
                    lines = True
                    break
            pieces = [(0, b"".join(head), lines)]
            if lines:
                tail = []
                for i in range(len(members) - 1, used - 2, -1):
                    text = zlib.decompress(members[i], 31)
                    at = text.rfind(b"\n")
                    tail.append(text[at + 1 :])
                    if at >= 0:
                        break
                pieces.append((1 << 40, b"".join(reversed(tail)), False))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(pieces)), pa.array([start] * len(pieces), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), (pa.int64(), pa.binary(), pa.bool_()), strict=True))], names=["_file", "block", "row", "_piece", "_ends"])

    return run


def read_blocks(spark: SparkSession, path: str) -> DataFrame | None:
    """Lines of BGZF with their order in the file: (value, block, row); None if the file isn't BGZF or can't be cut.

    The file is cut at its blocks' beginnings into byte ranges as any text is, and every task unpacks its own blocks. Of a line that lies in
    several ranges each has a piece; these pieces alone, two for a range, are shuffled and joined. ``block`` is the
    start of the range in which a line begins, ``row`` its place there. A damaged or cut off block is an error.
    """
    prefix = block_prefix(first_bytes(spark, path))
    options = _raw_options(spark, path, prefix) if prefix else None
    if options is None:
        return None
    package.send(spark)
    raw = spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("_data"))
    inside = raw.mapInArrow(_lines(prefix), "_file string, block long, row long, value binary").select("value", "block", "row")
    pieces = raw.mapInArrow(_edges(prefix), "_file string, block long, row long, _piece binary, _ends boolean")
    before = Window.partitionBy("_file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("_line", F.coalesce(F.sum(F.col("_ends").cast("long")).over(before), F.lit(0)))
    grouped = numbered.groupBy("_file", "_line").agg(F.array_sort(F.collect_list(F.struct("block", "row", "_piece"))).alias("_all"), F.max("_ends").alias("_ends"))
    whole = F.aggregate("_all", F.lit(b""), lambda a, x: F.concat(a, x["_piece"]))
    first = F.get("_all", F.lit(0))
    joined = grouped.select(whole.alias("value"), first["block"].alias("block"), first["row"].alias("row"), "_ends").where(F.col("_ends") | (F.length("value") > 0)).drop("_ends")
    return inside.unionByName(joined).withColumn("value", F.col("value").cast("string")).withColumn("value", without_returns("value"))


# Writing.


def _pack(compress: bool):
    def run(frames):
        import pandas as pd

        for frame in frames:
            data = "".join(f"{x}\n" for x in frame["value"]).encode()
            yield pd.DataFrame({"data": [blocks(data) if compress else data]})

    return run


def write_lines(lines: DataFrame, header: list[str], out, order: tuple[str, ...] = ("block", "row"), compress: bool = False) -> int:
    """Writes header and lines to an open binary stream in order, as to standard output, and returns the number of lines.

    Tasks make complete blocks; the driver joins them one partition at a time. For a file there is ``write_file``, past the driver.
    """
    package.send(lines.sparkSession)
    head = "".join(f"{x}\n" for x in header).encode()
    out.write(blocks(head) if compress else head)
    seen = Observation()
    ordered = lines.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(*order).select("value").persist()
    try:
        for row in ordered.mapInPandas(_pack(compress), "data binary").toLocalIterator():
            out.write(bytes(row.data))
        count = ordered.count()
    finally:
        ordered.unpersist()
    if compress:
        out.write(EOF_BLOCK)
    return count


def _blocks_of_lines(batches):
    """Whole blocks, CHUNK bytes of text and more a row."""
    parts, size = [], 0
    for batch in batches:
        column = batch.column("value").cast(pa.large_binary())
        for a in range(0, len(column), 10_000):
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(part := column.slice(a, 10_000))], pa.int64()), part), pa.scalar(b"\n", pa.large_binary()))[0].as_py() + b"\n"
            parts.append(text)
            size += len(text)
            if size >= CHUNK:
                data = b"".join(parts)
                whole = size - size % BLOCK
                yield pa.RecordBatch.from_arrays([pa.array([blocks(data[:whole])], pa.binary())], names=["value"])
                parts, size = [data[whole:]], size - whole
    if size:
        yield pa.RecordBatch.from_arrays([pa.array([blocks(b"".join(parts))], pa.binary())], names=["value"])


@dataclass
class Written:
    """What ``write_file`` wrote: ``parts`` in order, if they could not be joined into the file at ``path``; and what was observed of the lines."""

    path: str
    parts: list[str]
    counts: dict[str, int]


def write_file(lines: DataFrame, header: list[str], path: str, order: tuple[str, ...] = ("block", "row"), compress: bool = False, extent: int | None = None, spread: tuple[int, int] | None = None, in_order: bool = False, count: dict | None = None, part_bytes: int = PART_BYTES) -> Written:
    """Writes header and lines in order to a file on any file system that Spark writes to; no line goes through the driver.

    Tasks write parts, in BGZF whole blocks and an empty block after each few, so parts joined are one file. A local file system copies them
    together, others concatenate them if they can; where they can't, ``path`` is a folder with the parts and ``_manifest.json``, which lists them in order.
    The lines are worked out once. ``in_order``: lines as they were read from one plain file, a range of it in each partition, so nothing is shuffled. Otherwise lines are dealt by ranges of
    ``order``; with ``extent``, above all values of its first column, by equal ranges of that, for which nothing is sampled, so that no line is made twice. ``spread``, the least
    and the greatest value of a first column that lies evenly between them, such as a hash, does the same, with as many ranges as a shuffle has partitions. ``count`` has names
    and aggregates of further columns to observe; ``n`` is the number of lines. A file that is there is replaced.
    """
    spark = lines.sparkSession
    package.send(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid.uuid4().hex}")
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("n"), *(c.alias(n) for n, c in (count or {}).items())]
    if in_order:
        placed = lines.withColumn("_part", F.spark_partition_id())
        measures.append(F.collect_set(F.struct("_part", order[0])).alias("_places"))
    elif extent is not None:
        n = int(min(max(-(-extent // part_bytes), 1), 1 << 15))
        number = F.least(F.floor(F.col(order[0]) * n / max(extent, 1)), F.lit(n - 1)).cast("int")
        placed = lines.repartitionById(n, number).sortWithinPartitions(*order)
    elif spread is not None:
        low, high = spread
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        number = F.floor((F.col(order[0]) - low) / (high - low + 1) * n).cast("int")
        placed = lines.repartitionById(n, F.greatest(F.least(number, F.lit(n - 1)), F.lit(0))).sortWithinPartitions(*order)
    else:
        placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    text = placed.observe(seen, *measures).select("value")
    if compress:
        text = text.mapInArrow(_blocks_of_lines, "value binary").select(F.col("value").cast("string").alias("value"))
        text.write.options(lineSep=EOF_BLOCK.decode("latin-1"), encoding="ISO-8859-1", compression="none").text(folder.toString())
    else:
        text.write.options(compression="none").text(folder.toString())
    counts = seen.get
    places = counts.pop("_places", None)
    names = {int(f.getPath().getName().split("-")[1]): f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()}
    if places is not None:
        starts: dict[int, set] = {}
        for p in places:
            starts.setdefault(p[0], set()).add(p[1])
        if any(len(x) > 1 for x in starts.values()) or len({min(x) for x in starts.values()}) < len(starts):
            # Several ranges in a partition, or one in several: the parts aren't in order.
            fs.delete(folder, True)
            return write_file(lines, header, path, order, compress, extent, spread, False, count, part_bytes)
        parts = [names[p] for p in sorted(names, key=lambda p: min(starts[p]))]
    else:
        parts = [names[p] for p in sorted(names)]
    head = "".join(f"{x}\n" for x in header).encode()
    first = jvm.org.apache.hadoop.fs.Path(folder, "header")
    stream = fs.create(first, True)
    stream.write(bytearray(blocks(head) + EOF_BLOCK if compress else head))
    stream.close()
    left = _join(fs, target, [first, *parts], folder)
    return Written(path, left, counts)


def _join(fs, target, parts: list, folder) -> list[str]:
    """Joins parts into ``target`` without reading them here; what is left as parts, in order, if the file system can't."""
    if fs.exists(target):
        fs.delete(target, True)
    if fs.getScheme() == "file":
        with open(target.toUri().getPath(), "wb") as out:
            for p in parts:
                with open(p.toUri().getPath(), "rb") as part:
                    _copy(part.fileno(), out.fileno())
        fs.delete(folder, True)
        return []
    try:
        if len(parts) > 1:
            fs.concat(parts[0], _paths(parts[1:]))
        fs.rename(parts[0], target)
        fs.delete(folder, True)
        return []
    except Exception as e:  # noqa: BLE001
        if "UnsupportedOperation" not in str(e):
            raise
    names = [p.getName() for p in parts]
    stream = fs.create(folder.suffix("/_manifest.json"), True)
    stream.write(bytearray(json.dumps({"parts": names}).encode()))
    stream.close()
    fs.rename(folder, target)
    return [f"{target.toString()}/{n}" for n in names]


def _paths(paths: list):
    from pyspark import SparkContext

    gateway = SparkContext._active_spark_context._gateway
    array = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        array[i] = p
    return array


def _copy(source: int, sink: int) -> None:
    """Bytes from file to file in the kernel."""
    left = os.fstat(source).st_size
    while left:
        try:
            left -= os.copy_file_range(source, sink, left)
        except OSError:
            left -= os.sendfile(sink, source, None, left)
