"""Annotation: the ID column of VCF lines is replaced by identifiers, everything else stays."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.functions.alleles import encode_slot
from locuskey.functions.assembly import Scheme, linear_position, parse_assembly_name, resolve_contig, ucsc_name
from locuskey.functions.ids import compose_key, dashed, encode_key, name_digest, uuid5, uuid5_of
from locuskey.operators.normalize import normalize
from locuskey.sources.bgzf import write_file, write_lines
from locuskey.sources.refgenome import open_for_assembly
from locuskey.sources.vcf import once, read_header, read_lines, symbolic


def _fields() -> Column:
    return F.split("value", "\t", 6)


def _position(text: Column) -> Column:
    """A position as the 32-bit number that a text spells, with or without a plus sign; null if it spells none."""
    number = F.when(text.rlike(r"^\+?[0-9]{1,18}$"), text.try_cast("bigint"))
    return F.when(number <= 4294967295, number)


def _allele_id(alt: Column, linear: Column, code: Column, ref_slot: Column, use_uuid: bool) -> Column:
    key = compose_key(linear, code, ref_slot, encode_slot(alt))
    return F.when(symbolic(alt), F.lit(".")).otherwise(F.coalesce(uuid5(key) if use_uuid else dashed_words(key), F.lit(".")))


def dashed_words(key: Column) -> Column:
    return F.regexp_replace(key, "^(.{8})(.{8})(.{8})", "$1-$2-$3-")


def annotate_lines(lines: DataFrame, scheme: Scheme | str, code: int, use_uuid: bool = False, kept: str | None = None) -> DataFrame:
    """Data lines with new IDs; other columns of ``lines`` stay; ``kept`` names a further one, whether a line of five fields stays as it is.

    A line with fewer than five fields, on an unknown contig or without a position stays as it is. POS is
    written as a plain number, ALT alleles without white space round them; their IDs are joined with ``_``,
    ``.`` for one that has none. Narrow projections only: no shuffle. What several expressions need is a
    projection of its own, and only lines with several ALT alleles go through a higher-order function. A filter on
    the new line does not work it out again.
    """
    asm = F.lit(code)
    f = lines.withColumn("_f", _fields())
    get = lambda i: F.get("_f", F.lit(i))
    f = f.withColumns({"_index": resolve_contig(get(0), scheme, asm), "_pos": _position(get(1)), "_ref": get(3), "_alt": F.trim(get(4))})
    f = f.withColumns({"_lin": linear_position("_index", "_pos", asm), "_slot": encode_slot("_ref")})
    one = lambda alt: _allele_id(alt, F.col("_lin"), asm, F.col("_slot"), use_uuid)
    several = F.instr("_alt", ",") > 0
    # For a single allele the key, and the digest of it, are projections of their own; a lambda cannot have any.
    f = f.withColumn("_key", F.when(~several & ~symbolic("_alt"), compose_key("_lin", asm, "_slot", encode_slot("_alt"))))
    if use_uuid:
        f = f.withColumn("_digest", name_digest("_key"))
    alone = F.coalesce(F.when(F.col("_key").isNotNull(), uuid5_of("_digest") if use_uuid else dashed("_key")), F.lit("."))
    alts = F.transform(F.split("_alt", ","), lambda a: F.trim(a))
    new_id = F.when(several, F.array_join(F.transform(alts, one), "_")).otherwise(alone)
    alt = F.when(several, F.array_join(alts, ",")).otherwise(F.col("_alt"))
    line = F.concat_ws("\t", get(0), F.col("_pos").cast("string"), new_id, F.col("_ref"), alt, get(5))
    sound = (F.size("_f") >= 5) & F.col("_index").isNotNull() & (F.col("_pos") > 0)
    ok = F.coalesce(sound, F.lit(False))
    made = once(F.when(ok, line).otherwise(F.col("value")).alias("value"), *([((F.size("_f") >= 5) & ~ok).alias(kept)] if kept else []))
    new = f.select(*[c for c in lines.columns if c != "value"], made)
    return new.select(*lines.columns, *([kept] if kept else []))


def cannot_encode(lines: DataFrame, scheme: Scheme | str, code: int) -> DataFrame:
    """Lines with five fields or more that stay as they are: (chrom, pos) as text."""
    f = _fields()
    get = lambda i: F.get(f, F.lit(i))
    sound = resolve_contig(get(0), scheme, F.lit(code)).isNotNull() & (_position(get(1)) > 0)
    return lines.where((F.size(f) >= 5) & ~F.coalesce(sound, F.lit(False))).select(get(0).alias("chrom"), get(1).alias("pos"))


def annotate_normalized(lines: DataFrame, scheme: Scheme | str, code: int, reference: DataFrame, use_uuid: bool = False, key: tuple[str, ...] = ("block", "row"), kept: str | None = None) -> DataFrame:
    """Like ``annotate_lines``, each ALT allele normalised on its own; POS and REF are those of the first allele.

    ``key`` are columns that tell lines apart; ``kept`` is as there.
    """
    f = _fields()
    get = lambda i: F.get(f, F.lit(i))
    asm = F.lit(code)
    keyed = lines.withColumn("_index", resolve_contig(get(0), scheme, asm)).withColumn("_pos", _position(get(1)))
    sound = F.coalesce((F.size(f) >= 5) & F.col("_index").isNotNull() & (F.col("_pos") > 0) & (get(4) != "."), F.lit(False))
    wanted, rest = keyed.where(sound), annotate_lines(keyed.where(~sound).drop("_index", "_pos"), scheme, code, use_uuid, kept)
    alleles = wanted.select(*key, "_index", "_pos", get(3).alias("_ref"), F.posexplode(F.transform(F.split(get(4), ","), lambda a: F.trim(a))).alias("_i", "_alt")).withColumn("_contig", ucsc_name("_index"))
    normal = normalize(alleles, reference, contig="_contig", pos="_pos", ref="_ref", alt="_alt", strict=True)
    odd = symbolic("_alt")
    code_key = encode_key(F.col("_index"), F.col("norm_pos"), F.col("norm_ref"), F.col("norm_alt"), asm)
    one = normal.select(*key, F.struct("_i", F.when(odd, F.lit(".")).otherwise(F.coalesce(uuid5(code_key) if use_uuid else dashed(code_key), F.lit("."))).alias("id"), F.when(odd, F.col("_pos")).otherwise(F.col("norm_pos")).alias("pos"), F.when(odd, F.col("_ref")).otherwise(F.col("norm_ref")).alias("ref"), F.when(odd, F.col("_alt")).otherwise(F.col("norm_alt")).alias("alt")).alias("_one"))
    together = one.groupBy(*key).agg(F.array_sort(F.collect_list("_one")).alias("_all"))
    first = F.get("_all", F.lit(0))
    line = F.concat_ws("\t", get(0), first["pos"].cast("string"), F.array_join("_all.id", "_"), first["ref"], F.array_join("_all.alt", ","), get(5))
    done = wanted.join(together, list(key)).withColumn("value", line)
    return done.select(*lines.columns, *([F.lit(False).alias(kept)] if kept else [])).unionByName(rest)


def annotate_file(spark: SparkSession, source: str, sink: str | None = None, use_uuid: bool = False, assembly: str | None = None, normalize_alleles: bool = False, reference: DataFrame | None = None, warn: bool = True) -> int:
    """Annotates a VCF file, plain or gzip, and returns the number of data lines.

    The assembly is the given one or that of the header; without either the call fails. A sink named
    .vcf.gz or .vcf.bgz is BGZF, another one plain, none standard output. The lines of a sink are worked out once and written by the tasks, see
    ``write_file``; only if some have no identifier and ``warn`` holds are these read again, to be named on standard error.
    """
    given = None if assembly is None else parse_assembly_name(assembly)
    header, zipped = read_header(spark, source)
    code = header.assembly(given)
    scheme = header.scheme(sniff=True)
    lines = read_lines(spark, source, zipped).where(~F.col("value").startswith("#"))
    # A plain file's ranges lie in its partitions in order.
    in_order = not zipped and not normalize_alleles
    if header.first_record == "":
        # A blank line right after the header is a record; later ones are none.
        blank = lines.where("value = ''").orderBy("block", "row").limit(1)
        lines, in_order = lines.where("value <> ''").unionByName(blank), False
    else:
        lines = lines.where("value <> ''")
    if normalize_alleles:
        genome = reference if reference is not None else open_for_assembly(spark, code)
        new = annotate_normalized(lines, scheme, code, genome, use_uuid, kept="_kept")
    else:
        new = annotate_lines(lines, scheme, code, use_uuid, "_kept")
    if sink is None:
        if warn:
            _name_kept(lines, scheme, code)
        return write_lines(new, header.lines, sys.stdout.buffer)
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    extent = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() + 1
    done = write_file(new, header.lines, sink, compress=sink.endswith((".vcf.gz", ".vcf.bgz")), extent=extent, in_order=in_order, count={"kept": F.sum(F.col("_kept").cast("long"))})
    if warn and done.counts["kept"]:
        _name_kept(lines, scheme, code)
    return done.counts["n"]


def _name_kept(lines: DataFrame, scheme: Scheme, code: int) -> None:
    for row in cannot_encode(lines, scheme, code).toLocalIterator():
        print(f"{row.chrom}:{row.pos} has no identifier: its line stays as it is", file=sys.stderr)
