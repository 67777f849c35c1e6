"""VCF text as DataFrames: headers on the driver, records as column expressions."""

from __future__ import annotations

import gzip
import io
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.functions.alleles import encode_slot
from locuskey.functions.assembly import AssemblyNotDetectedError, Scheme, detect_assembly, detect_scheme, linear_position, resolve_contig
from locuskey.functions.ids import compose_key
from locuskey.sources import package
from locuskey.sources.bgzf import read_blocks, without_returns

GZIP_MAGIC = b"\x1f\x8b"
#: A missing, overlapping, symbolic or breakend allele: nothing to spell.
SYMBOLIC = r"^\.$|^\*$|^<|[\[\]]"


def symbolic(alt) -> Column:
    """What SYMBOLIC says, without a pattern."""
    a = F.col(alt) if isinstance(alt, str) else alt
    return a.isin(".", "*") | a.startswith("<") | a.contains("[") | a.contains("]")


_FIXED = 9


@dataclass
class Header:
    """A header's lines and what they define."""

    lines: list[str] = field(default_factory=list)
    first_record: str | None = None

    @property
    def text(self) -> str:
        return "".join(f"{x}\n" for x in self.lines)

    def definitions(self, kind: str) -> list[dict[str, str]]:
        """The ``##kind=<..>`` lines, as keys and values."""
        return [parse_structured(x) for x in self.lines if x.startswith(f"##{kind}=<")]

    @property
    def contig_ids(self) -> list[str]:
        return [d["ID"] for d in self.definitions("contig") if "ID" in d]

    @property
    def samples(self) -> list[str]:
        names = next((x for x in self.lines if x.startswith("#CHROM")), "").split("\t")
        return names[_FIXED:]

    @property
    def types(self) -> dict[str, dict[str, tuple[str, str]]]:
        return {kind: {d["ID"]: (d.get("Number", "."), d.get("Type", "String")) for d in self.definitions(kind) if "ID" in d} for kind in ("INFO", "FORMAT")}

    def definitions_json(self, kind: str) -> str:
        """JSON array of the definitions: id, number, type, description; for contigs id and, if known, length."""
        if kind == "contig":
            return json.dumps([{"id": d["ID"]} | ({"length": int(d["length"])} if d.get("length", "").isdigit() else {}) for d in self.definitions(kind) if "ID" in d])
        return json.dumps([{"id": d.get("ID"), "number": d.get("Number"), "type": d.get("Type"), "description": d.get("Description")} for d in self.definitions(kind)])

    def scheme(self, sniff: bool = False) -> Scheme:
        """By the contig lines; without any, by the first record if ``sniff``, else bare."""
        if self.contig_ids:
            return detect_scheme(self.contig_ids)
        return detect_scheme([self.first_record.split("\t")[0]]) if sniff and self.first_record is not None else Scheme.BARE

    def assembly(self, given: int | None = None) -> int:
        code = detect_assembly(self.lines) if given is None else given
        if code is None:
            raise AssemblyNotDetectedError("the header does not name an assembly; give one")
        return code


def parse_structured(line: str) -> dict[str, str]:
    """Keys and values of a ``##KEY=<a=b,c="d, e">`` line."""
    body = line.partition("=")[2].strip().removeprefix("<").removesuffix(">")
    return {k: (quoted.replace('\\"', '"').replace("\\\\", "\\") if plain == "" and quoted is not None else plain) for k, quoted, plain in re.findall(r'([^=,]+)=(?:"((?:[^"\\]|\\.)*)"|([^,]*))', body)}


def _open(spark: SparkSession, path: str):
    """(a reader of lines in the JVM, whether the file is gzip by its first bytes)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = jvm.java.io.BufferedInputStream(fs.open(p))
    stream.mark(4)
    zipped = bytes(x & 0xFF for x in (stream.read(), stream.read()) if x >= 0) == GZIP_MAGIC
    stream.reset()
    inner = jvm.java.util.zip.GZIPInputStream(stream) if zipped else stream
    return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(inner, "UTF-8")), zipped


def read_header(spark: SparkSession, path: str) -> tuple[Header, bool]:
    """The header of a file, plain or gzip, read no further than its first record; and whether it is gzip."""
    reader, zipped = _open(spark, path)
    header = Header()
    try:
        while (line := reader.readLine()) is not None:
            if not line.startswith("#"):
                header.first_record = line
                break
            header.lines.append(line)
    finally:
        reader.close()
    return header, zipped


def _unzip(batches):
    for batch in batches:
        for content in batch.column("content").to_pylist():
            stream, row = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))), 0
            while part := stream.readlines(1 << 22):
                lines = [x.rstrip(b"\r\n") for x in part]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array([0] * len(part), pa.int64()), pa.array(range(row, row + len(part)), pa.int64())], names=["value", "block", "row"])
                row += len(part)


def read_lines(spark: SparkSession, path: str, zipped: bool = False) -> DataFrame:
    """Lines with their order in the file: (value, block, row).

    Plain files and BGZF are read in parallel, whatever their names. Other gzip is no splittable format: one task reads
    it, and where the name does not say that a file is gzip it is one binary value, unpacked as a stream.
    """
    if zipped and (blocks := read_blocks(spark, path)) is not None:
        return blocks
    if zipped and not path.endswith(".gz"):
        package.send(spark)
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_unzip, "value binary, block long, row long").withColumn("value", F.col("value").cast("string"))
    lines = spark.read.text(path)
    return lines.select(without_returns("value").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))


def _json_string(x: Column) -> Column:
    quoted = F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return F.when(x.rlike("^[A-Za-z0-9_.]*$"), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(quoted)


def _json_value(value: Column, key: Column, types: dict[str, tuple[str, str]]) -> Column:
    """JSON of a field's text by the number and type declared for its key, one text if none are; ``.`` is null. ``value`` and ``key`` are best variables of a lambda."""
    kinds: dict[tuple[bool, str], list[str]] = {}
    for k, (number, kind) in types.items():
        kind = kind if kind in ("Flag", "Integer", "Float") else "String"
        kinds.setdefault((number != "1" and kind != "Flag", kind), []).append(k)

    def one(x: Column, kind: str) -> Column:
        if kind == "String":
            return F.when(x == ".", "null").otherwise(_json_string(x))
        return F.when(x == ".", "null").otherwise(F.coalesce(x.try_cast("bigint" if kind == "Integer" else "float").cast("string"), F.lit("null")))

    def spelled(many: bool, kind: str) -> Column:
        if kind == "Flag":
            return F.lit("true")
        return F.concat(F.lit("["), F.array_join(F.transform(F.split(value, ","), lambda x: one(x, kind)), ","), F.lit("]")) if many else one(value, kind)

    kinds.pop((False, "String"), None)  # as what isn't declared
    out = None
    for (many, kind), keys in kinds.items():
        out = (F if out is None else out).when(key.isin(*keys), spelled(many, kind))
    return spelled(False, "String") if out is None else out.otherwise(spelled(False, "String"))


def _json_object(entries: Column) -> Column:
    """JSON of an array of (key, value text), keys in order."""
    fields = F.transform(F.sort_array(entries), lambda e: F.concat(_json_string(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def info_json(info: Column, types: dict[str, tuple[str, str]]) -> Column:
    """INFO as a JSON object; a key without a value, and a flag, is true; ``.`` is the empty object."""
    items = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    # Cut first, so that keys and values are variables that are worked out once.
    cut = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("text")))
    value = lambda e: F.when(e["text"].isNull(), F.lit("true")).otherwise(_json_value(e["text"], e["key"], types))
    return _json_object(F.transform(cut, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))


def sample_value(keys: Column, values: Column, key: str) -> Column:
    """The text of a sample's field by its FORMAT key; null where it is ``.`` or left out."""
    found = F.get(values, (F.array_position(keys, key) - 1).cast("int"))
    return F.when(found != ".", found)


def format_extra(keys: Column, values: Column, types: dict[str, tuple[str, str]]) -> Column:
    """JSON of the fields other than GT, DP and GQ that have a value; null if there are none. Trailing fields may be left out."""
    pairs = F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value")))
    rest = F.filter(pairs, lambda e: ~e["key"].isin("GT", "DP", "GQ") & (e["value"] != "."))

    def spelled(found: Column) -> Column:
        entries = F.transform(found, lambda e: F.struct(e["key"].alias("key"), _json_value(e["value"], e["key"], types).alias("value")))
        return F.when(F.size(found) > 0, _json_object(entries))

    return F.get(F.transform(F.array(rest), spelled), F.lit(0))


def genotype(gt: Column) -> tuple[Column, Column, Column]:
    """(first allele, second allele, phased) of a GT text; further alleles are not looked at."""
    alleles = F.split(F.translate(gt, "|", "/"), "/")
    # Only what may be a number is cast: a failed cast costs as much as the rest of a row.
    number = lambda x: F.when(x != ".", x.try_cast("int"))
    bar, slash = F.instr(gt, "|"), F.instr(gt, "/")
    return number(F.get(alleles, F.lit(0))), number(F.get(alleles, F.lit(1))), F.coalesce((bar > 0) & ((slash == 0) | (bar < slash)), F.lit(False))


def once(*columns: Column) -> Column:
    """Columns that are worked out here and nowhere else: one row of an inlined array, over which no filter and no projection is moved."""
    return F.inline(F.array(F.struct(*columns)))


def records(lines: DataFrame) -> DataFrame:
    """Data lines cut into fields: chrom, pos, ref, alts, qual, filter, info, format, samples, and the columns of ``lines`` but value."""
    f = F.col("_f")
    get = lambda i: F.get(f, F.lit(i))
    rest = [c for c in lines.columns if c != "value"]
    alts = F.when(F.coalesce(get(4), F.lit(".")).isin(".", ""), F.array(F.lit("."))).otherwise(F.split(get(4), ","))
    cut = data_lines(lines).withColumn("_f", F.split("value", "\t"))
    fields = [
        get(0).alias("chrom"),
        get(1).try_cast("bigint").alias("pos"),
        get(3).alias("ref"),
        alts.alias("alts"),
        F.when(get(5) != ".", get(5).try_cast("float")).alias("qual"),
        F.coalesce(F.when(get(6) != "", get(6)), F.lit(".")).alias("filter"),
        F.coalesce(get(7), F.lit(".")).alias("info"),
        get(8).alias("format"),
        F.when(F.size(f) > _FIXED, F.slice(f, _FIXED + 1, F.size(f) - _FIXED)).alias("samples"),
    ]
    return cut.select(*rest, once(*fields))


def variants(lines: DataFrame, scheme: Scheme, code: int) -> DataFrame:
    """A row for each ALT allele that can be encoded: key, lin, asm, allele (its place), multiallelic, and the record's columns.

    Records on unknown contigs, at position 0 or beyond their contig are dropped; ``*`` counts as missing.
    """
    asm = F.lit(code)
    r = records(lines).select("*", once(resolve_contig(F.col("chrom"), scheme, asm).alias("_index"))).where("_index is not null and pos > 0")
    one = r.withColumn("multiallelic", F.size("alts") > 1).select("*", F.posexplode("alts").alias("allele", "alt")).drop("alts")
    spelled = F.when(F.col("alt").isin(".", "*"), F.lit(".")).otherwise(F.col("alt"))
    parts = one.select("*", once(linear_position("_index", "pos", asm).alias("lin"))).where("lin is not null").withColumns({"_ref": encode_slot("ref"), "_alt": encode_slot(spelled)})
    return parts.withColumn("key", compose_key("lin", asm, "_ref", "_alt")).withColumn("asm", asm.cast("tinyint")).drop("_index", "_ref", "_alt")


def genotypes(found: DataFrame, samples: list[str], types: dict[str, tuple[str, str]] | None = None, wrap: bool = False) -> DataFrame:
    """A row for each allele and sample that isn't homozygous reference: key, lin, asm, sample, allele1, allele2, phased, dp, gq, format_extra, and order columns.

    ``wrap`` narrows as unsigned 8 and 16 bit integers do (alleles and GQ, DP); else values are kept.
    """
    names = F.array(*map(F.lit, samples)) if samples else F.array().cast("array<string>")
    pairs = F.arrays_zip(names.alias("name"), F.coalesce(F.col("samples"), F.array().cast("array<string>")).alias("cell"))
    rows = found.withColumn("_s", F.explode(F.slice(pairs, 1, max(len(samples), 1)))).where("_s.name is not null")
    fields = rows.select("*", once(F.split("format", ":").alias("_k"), F.split(F.coalesce(F.col("_s.cell"), F.lit(".")), ":").alias("_f")))
    value = lambda k: sample_value(F.col("_k"), F.col("_f"), k)
    fields = fields.select("*", once(value("GT").alias("_gt")))
    a1, a2, phased = genotype(F.col("_gt"))
    dp, gq = value("DP").try_cast("int"), value("GQ").try_cast("int")
    if wrap:
        a1, a2, gq = (F.pmod(x, F.lit(256)) for x in (a1, a2, gq))
        dp = F.pmod(dp, F.lit(65536))
    order = [c for c in ("block", "row", "allele") if c in found.columns]
    called = fields.select("key", "lin", "asm", *order, F.col("_s.name").alias("sample"), "_k", "_f", "_gt", once(a1.alias("allele1"), a2.alias("allele2")))
    called = called.where(~(F.coalesce(F.col("allele1") == 0, F.lit(False)) & F.coalesce(F.col("allele2") == 0, F.lit(False))))
    return called.select("key", "lin", "asm", *order, "sample", "allele1", "allele2", phased.alias("phased"), dp.alias("dp"), gq.alias("gq"), format_extra(F.col("_k"), F.col("_f"), types or {}).alias("format_extra"))


def table_prefix(path) -> Column:
    """The last part of a path without .vcf.gz, .vcf, .bcf or .gz."""
    return F.regexp_replace(F.regexp_extract(path if isinstance(path, Column) else F.col(path), "([^/]*)$", 1), r"(\.vcf\.gz|\.vcf|\.bcf|\.gz)$", "")
