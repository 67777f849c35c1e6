"""Reference genomes as chunk tables: (contig, chunk, start, seq), each chunk with some bases of the one before it.

Formats: in-memory sequences, FASTA with its index, 2bit. A lookup is an equi-join on contig and chunk.
"""

from __future__ import annotations

import os
import struct
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.functions.assembly import ASSEMBLIES
from locuskey.sources import package
from locuskey.sources.vcf import once

CHUNK = 1 << 12
#: Bases of the chunk before that a chunk repeats: no lookup reaches back further in one join.
LOOKBACK = 1 << 10
#: Chunks of a file that a task reads: 4 MB of bases.
RANGE = 1 << 10
#: The first and swapped magic number of the 2bit format, and its bases by code.
TWOBIT_MAGIC = 0x1A412743
TWOBIT_BASES = "TCAG"
DATA_DIR_VARIABLE = "LOCUSKEY_DATA_DIR"
SUFFIXES = (".2bit", ".fa", ".fasta", ".fa.gz", ".fasta.gz")
_SCHEMA = "contig string, chunk long, start long, seq string"


class ReferenceNotFoundError(ValueError):
    """No reference genome where one was looked for; the text lists the paths, ``assembly`` is whose genome it is."""

    def __init__(self, message: str, assembly: str | None = None):
        super().__init__(message)
        self.assembly = assembly


class UnsupportedFormatError(ValueError):
    """A file's suffix is none of the known ones."""


def data_dir() -> Path:
    """Folder of reference genomes: by environment variable, else under the user's data folder."""
    given = os.environ.get(DATA_DIR_VARIABLE)
    return Path(given) if given else Path(os.environ.get("XDG_DATA_HOME") or Path.home() / ".local/share") / "locuskey"


def find_reference(assembly: str, folder: Path | None = None) -> Path:
    """The first of <assembly>.2bit, .fa, .fasta that there is; FASTA counts only with its .fai."""
    folder = folder or data_dir()
    tried = []
    for suffix in (".2bit", ".fa", ".fasta"):
        path = folder / f"{assembly}{suffix}"
        tried.append(str(path))
        if path.exists() and (suffix == ".2bit" or Path(f"{path}.fai").exists()):
            return path
    raise ReferenceNotFoundError(f"no reference genome for {assembly}; tried {', '.join(tried)}", assembly)


def open_reference(spark: SparkSession, path: str | Path) -> DataFrame:
    """Chunk table of a file, by its suffix."""
    name = str(path)
    if name.endswith(".2bit"):
        return from_twobit(spark, name)
    if name.endswith((".fa", ".fasta", ".fa.gz", ".fasta.gz")):
        return from_fasta(spark, name)
    raise UnsupportedFormatError(f"not one of {', '.join(SUFFIXES)}: {name}")


def open_for_assembly(spark: SparkSession, code: int, folder: Path | None = None) -> DataFrame:
    return open_reference(spark, find_reference(ASSEMBLIES[code], folder))


def from_sequences(rows: DataFrame, contig: str = "contig", seq: str = "seq", chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    """Chunk table of a frame with one whole sequence per row; bases in upper case."""
    # Worked out once a sequence, not for each chunk.
    whole = rows.select(F.col(contig).cast("string").alias("contig"), once(F.upper(seq).alias("_s"))).select("*", once(F.length("_s").alias("_length"))).where("_length > 0")
    n = F.ceil(F.col("_length") / chunk)
    one = whole.select("contig", "_s", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    start = F.greatest(F.col("chunk") * chunk - lookback, F.lit(0).cast("long"))
    text = F.substring("_s", (start + 1).cast("int"), ((F.col("chunk") + 1) * chunk - start).cast("int"))
    return one.select("contig", "chunk", (start + 1).alias("start"), text.alias("seq"))


def from_dict(spark: SparkSession, sequences: dict[str, str], chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    return from_sequences(spark.createDataFrame(list(sequences.items()) or [("", "")], "contig string, seq string"), chunk=chunk, lookback=lookback)


def twobit_index(path: str) -> dict[str, int]:
    """Offset of each sequence's record in a 2bit file."""
    with open(path, "rb") as f:
        magic, version, count, _ = struct.unpack("<4I", f.read(16))
        if magic != TWOBIT_MAGIC or version != 0:
            raise ValueError(f"{path} is no little-endian 2bit file of version 0")
        out = {}
        for _ in range(count):
            name = f.read(f.read(1)[0]).decode("ascii")
            (out[name],) = struct.unpack("<I", f.read(4))
    return out


#: The four bases of each packed byte.
_FOUR = ["".join(TWOBIT_BASES[b >> s & 3] for s in (6, 4, 2, 0)) for b in range(256)]


class TwoBitSequence:
    """Random access to one sequence of a 2bit file: [start, end) from 0, only the bytes needed are read."""

    def __init__(self, file, offset: int):
        self.file = file
        file.seek(offset)
        (self.length,) = struct.unpack("<I", file.read(4))
        n, starts, sizes = self._blocks()
        self.unknown = list(zip(starts, sizes, strict=True))
        self._blocks()
        file.read(4)
        self.at = file.tell()

    def _blocks(self) -> tuple[int, tuple, tuple]:
        (n,) = struct.unpack("<I", self.file.read(4))
        return n, struct.unpack(f"<{n}I", self.file.read(4 * n)), struct.unpack(f"<{n}I", self.file.read(4 * n))

    def read(self, start: int, end: int) -> str:
        if not 0 <= start <= end <= self.length:
            raise IndexError(f"[{start}, {end}) is outside a sequence of {self.length} bases")
        self.file.seek(self.at + start // 4)
        packed = self.file.read(-(-end // 4) - start // 4)
        bases = "".join(map(_FOUR.__getitem__, packed))[start % 4 : start % 4 + end - start]
        for a, n in self.unknown:
            lo, hi = max(a, start), min(a + n, end)
            if lo < hi:
                bases = bases[: lo - start] + "N" * (hi - lo) + bases[hi - start :]
        return bases


def _table(spark: SparkSession, path: str, contigs: list[tuple[str, int]], opened, chunk: int, lookback: int) -> DataFrame:
    """Chunks of a file that all executors see, made where they are needed: RANGE chunks of a contig a task.

    ``contigs`` are names and lengths; ``opened`` takes the open file and a name, and gives a function that reads bases from start to end, from 0.
    """
    package.send(spark)
    counts = [(name, -(-length // chunk), length) for name, length in contigs if length]
    ranges = sum(-(-n // RANGE) for _, n, _ in counts)
    listed = spark.createDataFrame(counts, "contig string, n long, length long")
    spread = listed.select("contig", "n", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE))).alias("part")).repartition(max(1, min(ranges, 1 << 15)), "contig", "part")

    def rows(frames):
        import pandas as pd

        with open(path, "rb") as f:
            for frame in frames:
                for name, n, length, part in zip(frame.contig, frame.n, frame.length, frame.part, strict=True):
                    read = opened(f, name)
                    last = min((part + 1) * RANGE, n)
                    for a in range(part * RANGE, last, 256):
                        numbers = range(a, min(a + 256, last))
                        starts = [max(i * chunk - lookback, 0) for i in numbers]
                        bases = [read(start, min((i + 1) * chunk, length)).upper() for i, start in zip(numbers, starts, strict=True)]
                        yield pd.DataFrame({"contig": [name] * len(bases), "chunk": list(numbers), "start": [x + 1 for x in starts], "seq": bases})

    return spread.mapInPandas(rows, _SCHEMA)


def from_twobit(spark: SparkSession, path: str, chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    offsets = twobit_index(path)
    with open(path, "rb") as f:
        contigs = [(name, TwoBitSequence(f, offset).length) for name, offset in offsets.items()]
    return _table(spark, path, contigs, lambda f, name: TwoBitSequence(f, offsets[name]).read, chunk, lookback)


def fasta_index(path: str) -> dict[str, tuple[int, int, int, int]]:
    """(length, offset, bases per line, bytes per line) of each sequence, from <path>.fai."""
    out = {}
    with open(f"{path}.fai") as f:
        for line in f:
            if line.strip():
                name, *numbers = line.rstrip("\n").split("\t")
                out[name] = tuple(map(int, numbers[:4]))
    return out


def from_fasta(spark: SparkSession, path: str, chunk: int = CHUNK, lookback: int = LOOKBACK) -> DataFrame:
    """With an index by seeks, a range of a contig a task; a gzip file, or one without an index, as text."""
    if path.endswith(".gz") or not os.path.exists(f"{path}.fai"):
        lines = spark.read.text(path, lineSep=">").where("length(value) > 0")
        head = F.regexp_extract("value", r"^(\S+)", 1)
        seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s+", "")
        return from_sequences(lines.select(head.alias("contig"), seq.alias("seq")), chunk=chunk, lookback=lookback)
    index = fasta_index(path)

    def opened(f, name: str):
        _, offset, bases, width = index[name]
        where = lambda p: offset + p // bases * width + p % bases

        def read(a: int, b: int) -> str:
            f.seek(where(a))
            return b"".join(f.read(where(b) - where(a)).split()).decode("ascii")

        return read

    return _table(spark, path, [(name, x[0]) for name, x in index.items()], opened, chunk, lookback)


def with_bases(rows: DataFrame, reference: DataFrame, contig: str, first: Column, last: Column, into: str = "bases", chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the reference's bases from ``first`` to ``last`` (from 1, both included); null where they are not all there.

    A span must not be longer than a chunk's lookback (``with_long_bases`` takes others); it is looked up in the chunk of its last base.
    """
    spot = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).withColumn("_chunk", F.floor((F.col("_last") - 1) / chunk))
    ref = reference.select(F.col("contig").alias("_ref_contig"), F.col("chunk").alias("_ref_chunk"), F.col("start").alias("_ref_start"), F.col("seq").alias("_ref_seq"))
    joined = spot.join(ref, (F.col(contig) == F.col("_ref_contig")) & (F.col("_chunk") == F.col("_ref_chunk")), "left")
    n = (F.col("_last") - F.col("_first") + 1).cast("int")
    there = (F.col("_first") >= F.col("_ref_start")) & (F.col("_first") >= 1) & (F.col("_first") <= F.col("_last"))
    text = F.when(there, F.substring(F.col("_ref_seq"), (F.col("_first") - F.col("_ref_start") + 1).cast("int"), n))
    return joined.withColumn(into, F.when(F.length(text) == n, text)).drop("_first", "_last", "_chunk", "_ref_contig", "_ref_chunk", "_ref_start", "_ref_seq")


def with_whole_bases(rows: DataFrame, sequences: DataFrame, contig: str, first: Column, last: Column, into: str = "bases") -> DataFrame:
    """``with_bases`` for spans of any length, from a table of whole sequences (contig, seq): one join, no chunks.

    A row meets its contig's whole sequence, so this is for sequences of up to some megabytes. Bases come in upper case.
    """
    spot = rows.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
    whole = sequences.select(F.col("contig").cast("string").alias("_ref_contig"), F.col("seq").alias("_ref_seq")).withColumn("_ref_length", F.length("_ref_seq"))
    joined = spot.join(whole, F.col(contig) == F.col("_ref_contig"), "left")
    first, n = F.col("_first").cast("int"), (F.col("_last") - F.col("_first") + 1).cast("int")
    there = (F.col("_first") >= 1) & (F.col("_first") <= F.col("_last")) & (F.col("_last") <= F.col("_ref_length"))
    # In bytes, where each is a letter, a piece is found without counting the letters before it.
    plain = F.octet_length("_ref_seq") == F.col("_ref_length")
    text = F.when(plain, F.substring(F.col("_ref_seq").cast("binary"), first, n).cast("string")).otherwise(F.substring(F.col("_ref_seq"), first, n))
    return joined.withColumn(into, F.when(there, F.upper(text))).drop("_first", "_last", "_ref_contig", "_ref_seq", "_ref_length")


def with_long_bases(rows: DataFrame, reference: DataFrame, contig: str, first: Column, last: Column, into: str = "bases", chunk: int = CHUNK) -> DataFrame:
    """``with_bases`` for spans of any length.

    A span that begins before its last base's chunk row does is put together from all its chunks, once for all
    rows that ask for it. Only spans whose last base is there are cut into chunks, so a contig's length bounds their number.
    """
    spot = rows.withColumn("_f", first.cast("long")).withColumn("_l", last.cast("long"))
    at = lambda p: F.floor((F.col(p) - 1) / chunk)
    ref = reference.select(F.col("contig").alias("_k"), F.col("chunk").alias("_ref_chunk"), F.col("start").alias("_ref_start"), F.col("seq").alias("_ref_seq"))
    crossing = spot.where((F.col("_f") >= 1) & (at("_f") < at("_l"))).select(F.col(contig).alias("_k"), "_f", "_l").distinct()
    ends = ref.select("_k", F.col("_ref_chunk").alias("_at"), "_ref_start", (F.col("_ref_start") + F.length("_ref_seq") - 1).alias("_ref_end"))
    long = crossing.withColumn("_at", at("_l")).join(ends, ["_k", "_at"]).where((F.col("_f") < F.col("_ref_start")) & (F.col("_l") <= F.col("_ref_end")))
    parts = long.select("_k", "_f", "_l", F.explode(F.sequence(at("_f"), at("_l"))).alias("_ref_chunk")).join(ref, ["_k", "_ref_chunk"])
    a = F.greatest(F.col("_f"), F.col("_ref_chunk") * chunk + 1)
    b = F.least(F.col("_l"), (F.col("_ref_chunk") + 1) * chunk)
    text = F.substring(F.col("_ref_seq"), (a - F.col("_ref_start") + 1).cast("int"), (b - a + 1).cast("int"))
    whole = parts.groupBy("_k", "_f", "_l").agg(F.array_sort(F.collect_list(F.struct("_ref_chunk", text.alias("text")))).alias("_parts"))
    whole = whole.select(F.col("_k").alias("_long_k"), F.col("_f").alias("_long_f"), F.col("_l").alias("_long_l"), F.array_join(F.col("_parts.text"), "").alias("_long"))
    found = with_bases(spot, reference, contig, F.col("_f"), F.col("_l"), into, chunk)
    joined = found.join(whole, (F.col(contig) == F.col("_long_k")) & (F.col("_f") == F.col("_long_f")) & (F.col("_l") == F.col("_long_l")), "left")
    complete = F.when(F.length("_long") == F.col("_l") - F.col("_f") + 1, F.col("_long"))
    return joined.withColumn(into, F.coalesce(F.col(into), complete)).drop("_f", "_l", "_long_k", "_long_f", "_long_l", "_long")
