"""Queries over VCF files: lines of the driver's tables are written as a file to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.functions.assembly import LENGTHS, UCSC_NAMES, assembly_name
from locuskey.operators.annotate import annotate_file
from locuskey.operators.collection import Collection
from locuskey.plans import inputs
from locuskey.plans.catalogue import _GENOTYPES, _INFO, _NEW_LINE, _SQL_CHR1, _VCF, _sql_ids, query
from locuskey.plans.inputs import sql_dashed
from locuskey.sources import refgenome, vcf
from locuskey.sources.bgzf import write_file

HEADER = [
    "##fileformat=VCFv4.3",
    "##reference=GRCh38",
    *(f"##contig=<ID={name},length={length}>" for name, length in zip(UCSC_NAMES, LENGTHS["GRCh38"], strict=True) if length),
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Share, of each allele">',
    '##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">',
    *(f'##FORMAT=<ID={k},Number={n},Type={t},Description="{k}">' for k, (n, t) in inputs.FORMAT_TYPES.items()),
    "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *inputs.SAMPLES]),
]


def stored_file(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The path of a file with a line for each order line, BGZF by its name."""
    path = f"{inputs.shared_path(spark, 'vcf')}.{name}"
    write_file(inputs.vcf_lines(spark, sf_dir), HEADER, path, ("row",), spread=inputs.ROW_VALUES, compress=name.endswith("gz"))
    return path


@query(f"{_VCF} SELECT chrom, CAST(pos_at AS BIGINT) AS pos, ref, one AS alt, CAST(allele AS BIGINT) AS allele, key, qual, filter, k = 1 AS multiallelic, {_INFO} AS info, 'GRCh38' AS assembly FROM s")
def vcf_file_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_file(spark, sf_dir, "vcf.gz")
    header, zipped = vcf.read_header(spark, path)
    code = header.assembly()
    found = vcf.variants(vcf.read_lines(spark, path, zipped), header.scheme(), code)
    info = vcf.info_json(F.col("info"), header.types["INFO"])
    return found.select("chrom", "pos", "ref", "alt", F.col("allele").cast("long").alias("allele"), "key", F.col("qual").cast("double").alias("qual"), "filter", "multiallelic", info.alias("info"), assembly_name(F.lit(code)).alias("assembly"))


@query(f"{_VCF}, {_sql_ids(False)} SELECT {_NEW_LINE} AS line FROM l LEFT JOIN i USING (rid)")
def annotate_vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = stored_file(spark, sf_dir, "vcf")
    sink = source.removesuffix("vcf") + "new.vcf.bgz"
    annotate_file(spark, source, sink, warn=False)
    return vcf.data_lines(vcf.read_lines(spark, sink, True)).select(F.col("value").alias("line"))


@query(f"{_GENOTYPES} SELECT DISTINCT {sql_dashed('key')} AS variant_id FROM g WHERE sample = 'S1' AND NOT coalesce(allele1 = 0 AND allele2 = 0, false) AND {_SQL_CHR1}")
def add_vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's sites and genotypes added to a collection, and a sample searched in it."""
    c = Collection(spark, inputs.shared_path(spark, "collection"))
    prefix = c.add_vcf(stored_file(spark, sf_dir, "vcf.gz"))
    return c.search_region(f"{prefix}__S1", "chr1", 1, 200_000_000).select("variant_id")


@query(
    f"""WITH {inputs.sql_contigs()}, p AS (SELECT *, 1 + (doc_id * 7919) % length(seq) AS pos, 1 + doc_id % 700 AS n FROM c)
    SELECT doc_id, pos, n, CASE WHEN pos + n - 1 <= length(seq) THEN substr(seq, pos, n) END AS bases FROM p"""
)
def fasta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome written as FASTA, 60 bases a line, read again and looked up; null beyond a contig's end."""
    c = inputs.contigs_of_documents(spark, sf_dir)
    path = f"{inputs.shared_path(spark, 'genome')}.fa"
    c.select(F.concat(F.lit(">"), F.col("contig"), F.lit(" of a document\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    spans = c.select("doc_id", "contig", F.expr("1 + (doc_id * 7919) % length(seq)").alias("pos"), F.expr("1 + doc_id % 700").alias("n"))
    found = refgenome.with_bases(spans, refgenome.open_reference(spark, path), "contig", F.col("pos"), F.col("pos") + F.col("n") - 1)
    return found.select("doc_id", "pos", "n", "bases")
