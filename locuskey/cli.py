"""Command line: identifiers, annotation, collections, HGVS.

    python -m locuskey.cli encode chr1 100 A G
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import urllib.request
from pathlib import Path

from locuskey.functions.assembly import ASSEMBLIES, AssemblyNotDetectedError, parse_assembly_name
from locuskey.scalar import VariantId
from locuskey.sources.refgenome import DATA_DIR_VARIABLE, ReferenceNotFoundError, data_dir

# Where the reference genomes of the two assemblies are published.
GENOMES = {
    "GRCh38": "https://hgdownload.soe.ucsc.edu/goldenPath/hg38/bigZips/hg38.2bit",
    "GRCh37": "https://hgdownload.soe.ucsc.edu/goldenPath/hg19/bigZips/hg19.2bit",
}


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("locuskey").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def fetch_genome(assembly: str, folder: Path | None = None, opener=urllib.request.urlopen) -> Path:
    """Downloads a genome under a partial name and renames it when it is whole; an existing one stays."""
    folder = folder or data_dir()
    target = folder / f"{assembly}.2bit"
    if target.exists():
        return target
    folder.mkdir(parents=True, exist_ok=True)
    partial = target.with_suffix(".2bit.partial")
    with opener(GENOMES[assembly]) as source, open(partial, "wb") as out:
        shutil.copyfileobj(source, out)
    os.replace(partial, target)
    return target


def setup(a) -> int:
    """Fetches the genomes of the named assemblies, of all without a name; all names are looked at before anything is fetched."""
    for name in [ASSEMBLIES[parse_assembly_name(x)] for x in a.assembly or GENOMES]:
        print(fetch_genome(name))
    return 0


def offer_genome(lacking: ReferenceNotFoundError, ask=input, fetch=None) -> bool:
    """Whether a genome that was looked for in vain is there now: at a terminal the user is asked whether to fetch it; elsewhere they are told how to."""
    print(lacking, file=sys.stderr)
    if lacking.assembly in GENOMES and sys.stdin.isatty() and ask(f"Fetch the genome of {lacking.assembly} (about 800 MB)? [Y/n] ").strip().lower() in ("", "y", "yes"):
        (fetch or fetch_genome)(lacking.assembly)
        return True
    print(f"to install it: locuskey setup --assembly {lacking.assembly or '<name>'}\nit is looked for in {data_dir()}; {DATA_DIR_VARIABLE} names another folder", file=sys.stderr)
    return False


def add(a) -> int:
    missing = [f for f in a.files if not os.path.exists(f)]
    if missing:
        print(f"not found: {', '.join(missing)}", file=sys.stderr)
        return 1
    from locuskey.operators.collection import Collection

    c = Collection(_spark(), a.collection)
    for f in a.files:
        print(f"added {c.add_vcf(f, a.assembly)}")
    return 0


def vcf(a) -> int:
    if not os.path.exists(a.input):
        print(f"not found: {a.input}", file=sys.stderr)
        return 1
    from locuskey.operators.annotate import annotate_file

    run = lambda: annotate_file(_spark(), a.input, a.output, a.uuid, a.assembly, a.normalize)
    try:
        n = run()
    except ReferenceNotFoundError as e:
        if not offer_genome(e):
            return 1
        n = run()
    print(f"{n} records", file=sys.stderr)
    return 0


def _collection(a):
    if not os.path.exists(a.collection):
        raise OSError(f"not found: {a.collection}")
    from locuskey.operators.collection import Collection

    return Collection(_spark(), a.collection)


def samples(a) -> int:
    rows = _collection(a).meta.where("table_type = 'sample'").orderBy("table_name").collect()
    print(f"{'table':<32}{'sample':<20}source")
    for r in rows:
        print(f"{r.table_name:<32}{r.sample_name:<20}{r.source_file}")
    return 0


def info(a) -> int:
    c = _collection(a)
    print(f"sources: {len(c.list_sources())}\nsamples: {len(c.list_samples())}\nsites: {c.sites.count()}\ngenotypes: {c.genotypes.count()}")
    return 0


def search(a) -> int:
    start, _, end = a.span.partition("-")
    hits = _collection(a).search_region(a.table, a.chrom, int(start), int(end or start), a.assembly)
    columns = ["variant_id", "allele1", "allele2", "phased", "dp", "gq", "filter"]
    print("\t".join(columns))
    n = 0
    for row in hits.toLocalIterator():
        print("\t".join("." if (v := row.asDict().get(c)) is None else str(v) for c in columns))
        n += 1
    print(f"{n} rows", file=sys.stderr)
    return 0


def encode(a) -> int:
    v = VariantId.encode(a.chrom, a.pos, a.ref, a.alt, a.assembly)
    print(v.uuid5() if a.uuid else v.to_hex())
    return 0


def decode(a) -> int:
    d = VariantId.from_hex(a.id).decode()
    if d is None:
        print("the identifier cannot be decoded", file=sys.stderr)
        return 1
    for k, v in d.items():
        print(f"{k}: {v}")
    return 0


def _genome(a, code: int):
    from locuskey.sources.refgenome import open_for_assembly, open_reference

    spark = _spark()
    if a.reference:
        return spark, open_reference(spark, a.reference)
    try:
        return spark, open_for_assembly(spark, code)
    except ReferenceNotFoundError:
        return spark, None


def hgvs_encode(a) -> int:
    from locuskey.operators.hgvs_convert import hgvs_to_id

    spark, genome = _genome(a, parse_assembly_name(a.assembly or "GRCh38"))
    expected = None if a.assembly is None else parse_assembly_name(a.assembly)
    row = hgvs_to_id(spark.createDataFrame([(a.notation,)], "hgvs string"), reference=genome, expected=expected).first()
    if row.error:
        print(row.error, file=sys.stderr)
        return 1
    print(VariantId.from_hex(row.key).to_hex())
    return 0


def hgvs_decode(a) -> int:
    from locuskey.operators.hgvs_convert import id_to_hgvs

    v = VariantId.from_hex(a.id)
    spark, genome = _genome(a, (v.value >> 94) & 1) if a.detect else (_spark(), None)
    row = id_to_hgvs(spark.createDataFrame([(f"{v.value:032x}",)], "key string"), reference=genome, detect=a.detect).first()
    if row.error:
        print(row.error, file=sys.stderr)
        return 1
    for w in row.warnings:
        print(f"warning: {w}", file=sys.stderr)
    print(row.hgvs)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locuskey")
    commands = p.add_subparsers(dest="command", required=True)

    def command(f, name: str, *arguments, **options):
        c = commands.add_parser(name)
        for x in arguments:
            c.add_argument(x, **({"type": int} if x == "pos" else {"nargs": "+"} if x == "files" else {}))
        for x, o in options.items():
            c.add_argument(f"--{x}", **o)
        c.set_defaults(run=f)

    flag, assembly = {"action": "store_true"}, {"default": "GRCh38"}
    command(setup, "setup", assembly={"action": "append", "default": None})
    command(add, "add", "collection", "files", assembly=assembly)
    command(vcf, "vcf", "input", output={"default": None}, uuid=flag, assembly={"default": None}, normalize=flag)
    command(samples, "samples", "collection")
    command(info, "info", "collection")
    command(search, "search", "collection", "table", "chrom", "span", assembly=assembly)
    command(encode, "encode", "chrom", "pos", "ref", "alt", assembly=assembly, uuid=flag)
    command(decode, "decode", "id")
    command(hgvs_encode, "hgvs-encode", "notation", assembly={"default": None}, reference={"default": None})
    command(hgvs_decode, "hgvs-decode", "id", reference={"default": None}, detect=flag)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (AssemblyNotDetectedError, ReferenceNotFoundError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
