"""BGZF read by several tasks and written by several."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from locuskey.operators.annotate import annotate_file
from locuskey.sources import bgzf
from locuskey.sources.vcf import read_header, read_lines


def other_block(data):
    """A block with another time and one more field before the size, as other writers make them."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    extra = b"XY\x03\x00abc" + b"BC\x02\x00"
    return b"\x1f\x8b\x08\x04\x01\x02\x03\x04\x02\x03" + struct.pack("<H", len(extra) + 2) + extra + struct.pack("<H", 12 + len(extra) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def lines_of(seed, n=700):
    r = random.Random(seed)
    return ["".join(r.choice("abé日 \t") for _ in range(r.choice([0, 3, 40, 900, 5000 if i % 97 == 0 else 7]))) for i in range(n)]


def cut(data, seed, make=bgzf.block):
    """Blocks whose ends lie anywhere, inside a character too."""
    r, out, at = random.Random(seed), [], 0
    while at < len(data):
        n = r.choice([1, 30, 400, 3000])
        out.append(make(data[at : at + n]))
        at += n
    return b"".join(out)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("name", "end"), [("a.vcf.gz", "\n"), ("a.bgz", ""), ("a", "\n\n"), ("b.gz", "\r\n")])
def test_lines_of_blocks_equal_the_plain_ones(spark, small_ranges, tmp_path, name, end):
    lines = lines_of(name)
    text = "\n".join(lines) + end
    (tmp_path / name).write_bytes(cut(text.encode(), 1) + bgzf.EOF_BLOCK + cut(b"", 1) + bgzf.EOF_BLOCK)
    got = read_lines(spark, str(tmp_path / name), True)
    want = [x.rstrip("\r") for x in text.split("\n")]
    if want[-1] == "":
        want.pop()
    assert [r.value for r in got.orderBy("block", "row").collect()] == want
    assert got.select("block").distinct().count() > 5
    assert read_header(spark, str(tmp_path / name))[1]


def test_blocks_of_several_writers_and_damage(spark, small_ranges, tmp_path):
    a, b = "\n".join(lines_of(5)).encode(), "\n".join(lines_of(6)).encode()
    data = cut(a, 2) + cut(b, 3, other_block) + cut(a, 4)
    (tmp_path / "x.gz").write_bytes(data)
    want = (a + b + a).decode().split("\n")
    assert [r.value for r in read_lines(spark, str(tmp_path / "x.gz"), True).orderBy("block", "row").collect()] == want
    (tmp_path / "y.gz").write_bytes(cut(b, 3, other_block) + cut(a, 2))
    assert [r.value for r in read_lines(spark, str(tmp_path / "y.gz"), True).orderBy("block", "row").collect()] == (b + a).decode().split("\n")
    (tmp_path / "z.gz").write_bytes(data[:-5])
    with pytest.raises(Exception, match="damaged or cut off"):
        read_lines(spark, str(tmp_path / "z.gz"), True).count()


def test_odd_files(spark, tmp_path):
    for i, text in enumerate([b"", b"\n", b"one", b"one\n", b"\n\none"]):
        (tmp_path / f"{i}.gz").write_bytes(cut(text, 1) + bgzf.EOF_BLOCK)
        (tmp_path / f"{i}.bin").write_bytes(gzip.compress(text))
        want = text.decode().removesuffix("\n").split("\n") if text else []
        for name in (f"{i}.gz", f"{i}.bin"):
            assert [r.value for r in read_lines(spark, str(tmp_path / name), True).orderBy("block", "row").collect()] == want


@pytest.mark.parametrize("how", ["extent", "range", "in_order"])
@pytest.mark.parametrize("compress", [False, True])
def test_write_file(spark, small_ranges, tmp_path, how, compress):
    lines = [x for x in lines_of(9) if "\r" not in x]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    size = (tmp_path / "in.txt").stat().st_size
    df = read_lines(spark, str(tmp_path / "in.txt"))
    out = tmp_path / "out.gz"
    out.write_text("old")
    count = {"empty": F.count_if(F.col("value") == "")}
    done = bgzf.write_file(df, ["#h1", "#h2"], str(out), compress=compress, extent=size if how == "extent" else None, in_order=how == "in_order", count=count, part_bytes=3000)
    assert done.counts == {"n": len(lines), "empty": lines.count("")} and not done.parts
    data = out.read_bytes()
    assert (gzip.decompress(data) if compress else data).decode().split("\n") == ["#h1", "#h2", *lines, ""]
    if compress:
        assert data.endswith(bgzf.EOF_BLOCK)
        assert [r.value for r in read_lines(spark, str(out), True).orderBy("block", "row").collect()] == ["#h1", "#h2", *lines]
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_write_file_works_lines_out_once(spark, small_ranges, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    lines = lines_of(11)
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")

    def touch(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    df = read_lines(spark, str(tmp_path / "in.txt"))
    for n, how in enumerate(({"in_order": True}, {"extent": 10**6}), 1):
        bgzf.write_file(df.mapInPandas(touch, df.schema), [], str(tmp_path / f"{n}.gz"), compress=True, **how)
        assert seen.value == n * len(lines)


def test_partitions_out_of_order_are_dealt_again(spark, small_ranges, tmp_path):
    lines = lines_of(12)
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    df = read_lines(spark, str(tmp_path / "in.txt")).repartition(5)
    done = bgzf.write_file(df, [], str(tmp_path / "o.txt"), in_order=True, extent=10**6)
    assert (tmp_path / "o.txt").read_text().split("\n")[:-1] == lines and done.counts == {"n": len(lines)}


def test_empty_file(spark, tmp_path):
    none = spark.createDataFrame([], "value string, block long, row long")
    for name, z in (("a.vcf", False), ("a.vcf.gz", True)):
        assert bgzf.write_file(none, ["#h"], str(tmp_path / name), compress=z, extent=1).counts["n"] == 0
        data = (tmp_path / name).read_bytes()
        assert (gzip.decompress(data) if z else data) == b"#h\n"


class _Store:
    """A file system that cannot join files, standing in front of the local one."""

    def __init__(self, fs):
        self.fs = fs

    def getScheme(self):
        return "store"

    def concat(self, *_):
        raise RuntimeError("java.lang.UnsupportedOperationException: Not implemented")

    def __getattr__(self, name):
        return getattr(self.fs, name)


def test_parts_where_files_cannot_be_joined(spark, tmp_path):
    import json

    jvm = spark._jvm
    path = lambda *x: jvm.org.apache.hadoop.fs.Path(*x)
    folder = tmp_path / "o.parts"
    folder.mkdir()
    for n in ("header", "part-1", "part-0"):
        (folder / n).write_text(n)
    fs = path(str(tmp_path)).getFileSystem(spark._jsc.hadoopConfiguration())
    left = bgzf._join(_Store(fs), path(str(tmp_path / "o")), [path(str(folder / n)) for n in ("header", "part-1", "part-0")], path(str(folder)))
    assert [x.rsplit("/", 1)[1] for x in left] == ["header", "part-1", "part-0"]
    assert json.loads((tmp_path / "o" / "_manifest.json").read_text()) == {"parts": ["header", "part-1", "part-0"]}


def test_annotation_is_the_same_whatever_the_file(spark, small_ranges, tmp_path, capsys):
    r = random.Random(4)
    body = [f"chr{r.randint(1, 23)}\t{r.randint(1, 10**6)}\trs\t{r.choice('ACGT')}\t{r.choice(['A', 'C,<DEL>', '.', 'ACGT'])}\t.\tPASS\tDP={i}" for i in range(900)]
    text = "##reference=GRCh38\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + "\n".join(body) + "\n"
    (tmp_path / "plain.vcf").write_text(text)
    (tmp_path / "blocks.vcf.gz").write_bytes(cut(text.encode(), 8) + bgzf.EOF_BLOCK)
    (tmp_path / "gzip.vcf.gz").write_bytes(gzip.compress(text.encode()))
    out = []
    for name in ("plain.vcf", "blocks.vcf.gz", "gzip.vcf.gz"):
        for sink in ("x.vcf", "x.vcf.gz"):
            assert annotate_file(spark, str(tmp_path / name), str(tmp_path / sink)) == len(body)
            data = (tmp_path / sink).read_bytes()
            out.append(gzip.decompress(data) if sink.endswith("gz") else data)
    assert len(set(out)) == 1 and out[0].decode().count("\n") == len(body) + 2
    kept = sum(x.startswith("chr23\t") for x in body)
    assert capsys.readouterr().err.count("has no identifier") == 6 * kept > 0
