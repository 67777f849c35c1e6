"""HGVS notation to identifiers and back, over DataFrames; reference bases by a join with a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskey.functions import hgvs
from locuskey.functions.alleles import EXACT_BASES, encode_slot, fingerprints
from locuskey.functions.assembly import chrom_index, linear_position, parse_assembly, refseq_accession, refseq_index, ucsc_name
from locuskey.functions.ids import compose_key, with_decoded
from locuskey.sources import package
from locuskey.sources.refgenome import CHUNK, with_bases, with_long_bases, with_whole_bases
from locuskey.sources.vcf import once


def hgvs_to_id(rows: DataFrame, text: str = "hgvs", reference: DataFrame | None = None, expected: str | None = None, contig: str | None = None, chunk: int = CHUNK, strict: bool = False, long_alleles: bool = False) -> DataFrame:
    """``rows`` with chr_index, asm, pos, ref, alt, key, error and error_code, one of ``hgvs.ERRORS``.

    The assembly is the one whose accession it is, GRCh38 where both have it. ``expected`` is an assembly
    code that it must be. Bases come from ``reference``, looked up under column ``contig`` or the UCSC name;
    it is a chunk table, ``chunk`` being the length of its chunks (a span may lie over any number of them), or a table of whole sequences (contig, seq) of up to some megabytes. With ``strict`` a notation that has an error fails the query. With ``long_alleles``
    fingerprints are made in Python, a batch of alleles at once, which is worth it where many have hundreds of bases or more; the result is the same.
    """
    v = rows.select("*", once(hgvs.parse(text).alias("_v")))
    both = F.coalesce(F.when(refseq_index("_v.accession", F.lit(1)).isNotNull(), F.lit(1)), F.when(refseq_index("_v.accession", F.lit(0)).isNotNull(), F.lit(0)))
    v = v.withColumn("asm", both).withColumn("chr_index", refseq_index("_v.accession", F.col("asm"))).withColumn("_c", F.col(contig) if contig else ucsc_name("chr_index"))
    if reference is not None and "seq" in reference.columns and "chunk" not in reference.columns:
        v = with_whole_bases(v, reference, "_c", *hgvs.needed_span("_v"), "_b")
    elif reference is not None:
        v = with_long_bases(v, reference, "_c", *hgvs.needed_span("_v"), "_b", chunk)
    else:
        v = v.withColumn("_b", F.lit(None).cast("string"))
    v = v.select("*", once(hgvs.to_variant("_v", "_b").alias("_x")))
    made = {"ref": None, "alt": None}
    if long_alleles:
        package.send(rows.sparkSession)
        by_batch = F.arrow_udf(fingerprints, "long")
        made = {c: f"_{c}_print" for c in made}
        v = v.withColumns({n: by_batch(F.when(F.length(f"_x.{c}") > EXACT_BASES, F.col(f"_x.{c}"))) for c, n in made.items()})
    # Each allele's code is worked out once: the key reads one of them twice.
    v = v.select("*", once(encode_slot("_x.ref", made["ref"]).alias("_rs"), encode_slot("_x.alt", made["alt"]).alias("_as")))
    v = v.withColumn("_key", compose_key(linear_position(F.col("chr_index"), F.col("_x.pos"), F.col("asm")), F.col("asm"), "_rs", "_as"))
    key = F.col("_key")
    error = F.coalesce(
        F.col("_v.error"),
        F.when(F.col("asm").isNull(), F.lit(hgvs.ERRORS["unknown_accession"])),
        F.when(F.col("asm") != F.lit(expected).cast("int") if expected is not None else F.lit(False), F.lit(hgvs.ERRORS["assembly_mismatch"])),
        F.col("_x.error"),
        F.when(key.isNull(), F.lit(hgvs.ERRORS["outside_contig"])),
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat(hgvs.error_code(error), F.lit(": "), error, F.lit(": "), F.coalesce(F.col(text), F.lit("null"))))).otherwise(error)
    out = v.withColumn("error", error).withColumn("error_code", hgvs.error_code("error"))
    sound = F.col("error").isNull()
    for name in ("pos", "ref", "alt"):
        out = out.withColumn(name, F.when(sound, F.col(f"_x.{name}")))
    return out.withColumn("key", F.when(sound, key)).drop("_v", "_c", "_b", "_x", "_rs", "_as", "_key", *[n for n in made.values() if n])


def id_to_hgvs(rows: DataFrame, key: str = "key", reference: DataFrame | None = None, detect: bool = False, contig: str | None = None) -> DataFrame:
    """``rows`` with hgvs, warnings and error; ``detect`` looks for duplications (with a reference) and inversions."""
    # What several expressions need is worked out once: the fields, the kind of edit and the notation's parts.
    d = with_decoded(rows, key, "_fields").select("*", once(F.col("_fields").alias("_d"))).drop("_fields")
    index = chrom_index("_d.chr")
    accession = refseq_accession(index, parse_assembly("_d.assembly"))
    coord = F.when(F.col("_d.chr") == "M", "m").otherwise("g")
    if reference is not None and detect:
        n = F.length("_d.alt") - 1
        insertion = (F.length("_d.ref") == 1) & (n > 0)
        first = F.when(insertion, F.col("_d.pos") + 1)
        d = with_bases(d.withColumn("_c", F.col(contig) if contig else ucsc_name(index)), reference, "_c", first, F.when(insertion, F.col("_d.pos") + n), "_b").drop("_c")
    else:
        d = d.withColumn("_b", F.lit(None).cast("string"))
    d = d.select("*", once(hgvs.edit_of("_d.ref", "_d.alt", "_b", detect).alias("_edit")))
    # In lambdas: generated code for all their branches is a method too long for the JVM to compile.
    spelled = hgvs._let(F.col("_edit"), lambda e: hgvs.from_alleles(accession, coord, "_d.pos", "_d.ref", "_d.alt", "_d.ref_is_exact", "_b", detect, e))
    d = d.select("*", once(spelled.alias("_e")))
    sound = F.col("_d").isNotNull()
    notes = hgvs.warnings("_d.ref_len", "_d.alt_len", "_d.ref_is_exact", "_d.alt_is_exact", "_e.edit")
    return (
        d.withColumn("hgvs", F.when(sound, hgvs._let(F.col("_e"), hgvs.render)))
        .withColumn("warnings", F.when(sound, notes))
        .withColumn("error", F.when(~sound, F.lit("the identifier cannot be decoded")))
        .drop("_d", "_b", "_edit", "_e")
    )
