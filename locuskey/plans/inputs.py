"""Variants, VCF lines, genotypes and reference contigs made from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.functions.assembly import LENGTHS, NAMES, OFFSETS, _at
from locuskey.sources.vcf import once

ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LETTERS, _DNA = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, as in tests, in a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="locuskey-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dna(text: Column) -> Column:
    """Letters of a text as bases."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), _LETTERS, _DNA)


def sql_dna(e: str) -> str:
    return f"translate(lower(regexp_replace({e}, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_DNA}')"


def pick(values: list, index: Column) -> Column:
    return _at(values, index)


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_pick(by: dict[str, list], index: str, asm: str) -> str:
    return f"(CASE {asm} WHEN 0 THEN {sql_list(by['GRCh37'])} ELSE {sql_list(by['GRCh38'])} END)[({index}) + 1]"


def variants(spark: SparkSession, sf_dir: str, asm: str = "l_suppkey % 2") -> DataFrame:
    """A variant per order line: ci (contig index), name, asm, pos, k (kind), w (a word of bases), ref, alt."""
    rows = read(spark, sf_dir, "lineitem").select(*ROW, "l_quantity")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), dna(F.col("p_name")).alias("w"))
    v = rows.join(part, "l_partkey").select(*ROW, "w", F.col("l_quantity").cast("int").alias("qty"), F.expr(asm).cast("int").alias("asm"), (F.col("l_partkey") % 25).cast("int").alias("ci"))
    length = F.when(F.col("asm") == 0, pick(LENGTHS["GRCh37"], F.col("ci"))).otherwise(pick(LENGTHS["GRCh38"], F.col("ci")))
    v = v.withColumn("pos", 1 + F.expr("l_orderkey * 7919 + l_suppkey * 104729 + l_linenumber * 31") % length).withColumn("k", ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int"))
    base, n = F.substring("w", 1, 1), F.col("l_orderkey") % 4
    ref = F.when(F.col("k").isin(0, 1, 2, 4), base).when(F.col("k") == 3, F.col("w")).otherwise(F.repeat(F.col("w"), F.lit(3)))
    long = F.when(n == 0, "N").when(n == 1, "<DEL>").when(n == 2, ".").otherwise(F.lower(F.repeat(F.col("w"), F.lit(4))))
    alt = F.when(F.col("k") <= 2, F.translate(base, "ACGT", "CGTA")).when(F.col("k") == 3, base).when(F.col("k") == 4, F.col("w")).otherwise(long)
    return v.withColumn("name", pick(NAMES, F.col("ci"))).withColumn("ref", ref).withColumn("alt", alt)


def sql_variants(asm: str = "l_suppkey % 2") -> str:
    """CTEs, the last named v."""
    return f"""
v0 AS (SELECT {', '.join(ROW)}, {sql_dna('p_name')} AS w, CAST(l_quantity AS INTEGER) AS qty, CAST({asm} AS INTEGER) AS asm, CAST(l_partkey % 25 AS INTEGER) AS ci
       FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT *, 1 + (l_orderkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % {sql_pick(LENGTHS, 'ci', 'asm')} AS pos,
             CAST((l_orderkey + l_linenumber) % 6 AS INTEGER) AS k, {sql_list(NAMES)}[ci + 1] AS name,
             CASE WHEN (l_orderkey + l_linenumber) % 6 IN (0, 1, 2, 4) THEN w[1] WHEN (l_orderkey + l_linenumber) % 6 = 3 THEN w ELSE repeat(w, 3) END AS ref,
             CASE WHEN (l_orderkey + l_linenumber) % 6 <= 2 THEN translate(w[1], 'ACGT', 'CGTA') WHEN (l_orderkey + l_linenumber) % 6 = 3 THEN w[1] WHEN (l_orderkey + l_linenumber) % 6 = 4 THEN w
                  ELSE CASE l_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN '<DEL>' WHEN 2 THEN '.' ELSE lower(repeat(w, 4)) END END AS alt
      FROM v0)"""


def sql_fingerprint(e: str) -> str:
    return f"list_reduce(list_transform(string_split(upper({e}), ''), lambda c: CAST(greatest(instr('ACGT', c) - 1, 0) AS BIGINT)), lambda h, b: xor(((h << 2) | b) & 131071, (h >> 15) * 9), CAST(0 AS BIGINT))"


def sql_bytes(e: str) -> str:
    """A text with as many letters x for a character outside ASCII as it has UTF-8 bytes."""
    for first, last, n in (("\\x{80}", "\\x{7FF}", 2), ("\\x{800}", "\\x{FFFF}", 3), ("\\x{10000}", "\\x{10FFFF}", 4)):
        e = f"regexp_replace({e}, '[{first}-{last}]', '{'x' * n}', 'g')"
    return e


def sql_code(e: str) -> str:
    """An allele's 46-bit code."""
    digits = f"list_reduce(list_transform(string_split(upper({e}), ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT)), lambda h, b: h * 4 + b, CAST(0 AS BIGINT))"
    return f"""(CASE WHEN coalesce({e}, '') IN ('', '.') THEN CAST(0 AS BIGINT)
      WHEN regexp_full_match({e}, '[ACGTacgt]{{1,20}}') THEN (CAST(length({e}) AS BIGINT) << 40) | ({digits} << CAST(2 * (20 - length({e})) AS BIGINT))
      ELSE (CAST(1 AS BIGINT) << 45) | (CAST(length({e}) AS BIGINT) << 17) | {sql_fingerprint(e)} END)"""


def sql_linear(index: str, pos: str, asm: str) -> str:
    return f"(CASE WHEN {pos} BETWEEN 1 AND {sql_pick(LENGTHS, index, asm)} THEN {sql_pick(OFFSETS, index, asm)} + {pos} END)"


def sql_hex(e: str, digits: int = 8) -> str:
    return f"lower(lpad(to_hex({e}), {digits}, '0'))"


def sql_keyed(source: str, name: str, index: str = "ci", pos: str = "pos", ref: str = "ref", alt: str = "alt", asm: str = "asm") -> str:
    """CTEs that add rc, ac, linear and key to a CTE; the last is called ``name``."""
    return f"""
{name}_0 AS (SELECT *, {sql_code(ref)} AS rc, {sql_code(alt)} AS ac, {sql_linear(index, pos, asm)} AS linear FROM {source}),
{name} AS (SELECT *, {sql_hex('linear')} || {sql_hex(f'(CAST({asm} AS BIGINT) << 30) | ((rc >> 45) << 29) | ((rc & 35184372088831) >> 17)')}
      || {sql_hex('((rc & 131071) << 15) | ((ac >> 45) << 14) | ((ac & 35184372088831) >> 32)')} || {sql_hex('ac & 4294967295')} AS key FROM {name}_0)"""


def sql_dashed(e: str) -> str:
    return f"({e}[1:8] || '-' || {e}[9:16] || '-' || {e}[17:24] || '-' || {e}[25:32])"


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRCh38 VCF lines of two samples, one per order line, with its columns; some contigs, positions and alleles are odd."""
    v = variants(spark, sf_dir, "1")
    ln, ok, name = F.col("l_linenumber"), F.col("l_orderkey"), F.col("name")
    chrom = F.when(ln % 4 == 0, F.concat(F.lit("chr"), name)).when(ln % 4 == 1, name).when(ln % 4 == 2, F.concat(F.lit("CHR"), name)).otherwise(F.when(ok % 2 == 0, "chrUn").otherwise(F.concat(F.lit("chr"), name)))
    alts = F.when(F.col("k") == 1, F.concat(F.col("alt"), F.lit(","), F.translate("alt", "ACGT", "CGTA"))).when(F.col("k") == 2, F.lit(".")).otherwise(F.col("alt"))
    gt = F.when(ln % 3 == 0, "0/0").when(ln % 3 == 1, "0|1").otherwise("./1")
    return v.select(
        *ROW,
        "k",
        F.lit(0).cast("long").alias("block"),
        F.hash(*ROW).cast("long").alias("row"),
        # Like lines that are read: not made again for each filter on them.
        once(F.concat_ws(
            "\t",
            chrom,
            F.when(ok % 50 == 0, "0").otherwise(F.col("pos").cast("string")),
            F.lit("rs1"),
            F.col("ref"),
            alts,
            F.when(ok % 7 == 0, ".").otherwise((ok % 60).cast("string")),
            F.when(ok % 3 == 0, "PASS").when(ok % 3 == 1, "LowQual;q10").otherwise("."),
            F.concat(F.lit("DP="), F.col("qty").cast("string"), F.when(F.col("k") == 1, ";AF=0.5,0.25").otherwise(";AF=0.5"), F.when(ok % 2 == 0, ";DB").otherwise("")),
            F.lit("GT:DP:GQ:AD"),
            F.concat(gt, F.lit(":"), F.col("qty").cast("string"), F.lit(":99:"), ln.cast("string"), F.lit(",2")),
            F.when(ok % 5 == 0, "1").otherwise("0/0:7"),
        ).alias("value")),
    )


#: Between which the column ``row`` of ``vcf_lines`` lies evenly: hashes of 32 bits.
ROW_VALUES = (-(1 << 31), (1 << 31) - 1)
#: Declared fields of ``vcf_lines``.
INFO_TYPES = {"DP": ("1", "Integer"), "AF": ("A", "Float"), "DB": ("0", "Flag")}
FORMAT_TYPES = {"GT": ("1", "String"), "DP": ("1", "Integer"), "GQ": ("1", "Integer"), "AD": ("R", "Integer")}
SAMPLES = ["S1", "S2"]


def sql_vcf() -> str:
    """CTEs: l (the lines' fields) and s (their sites: one row per allele that can be encoded), with allele and alt."""
    return f"""{sql_variants('1')},
l AS (SELECT *, row_number() OVER () AS rid, CASE l_linenumber % 4 WHEN 0 THEN 'chr' || name WHEN 1 THEN name WHEN 2 THEN 'CHR' || name ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'chrUn' ELSE 'chr' || name END END AS chrom,
             CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE pos END AS pos_at,
             CASE k WHEN 1 THEN alt || ',' || translate(alt, 'ACGT', 'CGTA') WHEN 2 THEN '.' ELSE alt END AS alts,
             CASE l_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'LowQual;q10' ELSE '.' END AS filter,
             CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_orderkey % 60 AS DOUBLE) END AS qual FROM v),
a AS (SELECT *, unnest(string_split(alts, ',')) AS one, unnest(range(len(string_split(alts, ',')))) AS allele FROM l WHERE chrom <> 'chrUn' AND pos_at > 0),
{sql_keyed('a', 's', pos='pos_at', alt='one')}"""


#: Bases behind each document's letters, so that every document is a contig with room for an indel.
TAIL = "ACGTTGCAACGGATCCTTAGACCATGGTCAATCGTTGGAA"


def contigs_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, seq): the letters of each document as bases, and TAIL."""
    # Spelled once a document, not for each variant on it.
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contig"), "doc_id", once(F.concat(F.coalesce(dna(F.col("text")), F.lit("")), F.lit(TAIL)).alias("seq")))


def sql_contigs() -> str:
    return f"c AS (SELECT CAST(doc_id AS VARCHAR) AS contig, doc_id, coalesce({sql_dna('text')}, '') || '{TAIL}' AS seq FROM documents)"
