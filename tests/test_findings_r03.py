"""Findings of round 3: whole jobs, and steps whose cost does not grow faster than their rows."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

def test_stored_sites_are_those_of_all_order_lines(spark):
    from locuskey.plans import catalogue

    every = catalogue._searchable(spark, SF).where(F.col("lin").between(*catalogue._CHR1[2:])).select("source", "key").distinct()
    wanted = {tuple(r) for r in every.where(F.col("key").between(*catalogue._CHR1[:2])).collect()}
    found = {(r.source, r.key) for r in catalogue.search_stored_sites(spark, SF).collect()}
    assert found == wanted


def test_fingerprint_takes_whole_words_in(spark):
    """Texts round the length of a word, with other letters and characters of several bytes, against plain code; one step a word of bases."""
    from locuskey.functions import alleles
    from locuskey.scalar import fingerprint

    texts = ["", "A", "t" * 19, "GATTACA" * 3, "ACGTN" * 8, "C" * 41, "123-é\n𝄞 acgt" * 5, "GGTCA" * 3000]
    e = alleles.fingerprint("t")
    found = spark.createDataFrame([(x,) for x in texts], "t string").select(e.alias("f"), F.expr("1").alias("one")).collect()
    assert [r.f for r in found] == [fingerprint(x) for x in texts]
    assert "regexp_extract_all" in str(e)


def test_a_samples_fields_are_no_map(spark):
    """A missing allele, a lone one, fields left out; no map is built for a sample and nothing that cannot be a number is cast."""
    from locuskey.functions.assembly import Scheme
    from locuskey.sources import vcf

    cells = ["./1:7:99:3,2", "1:.", "0|1", "1/2|3:5", "0/0:9", "1|.:x:3:."]
    lines = spark.createDataFrame([(f"chr1\t{100 + i}\t.\tA\tC\t.\t.\t.\tGT:DP:GQ:AD\t{c}",) for i, c in enumerate(cells)], "value string")
    called = vcf.genotypes(vcf.variants(lines, Scheme.UCSC, 1), ["S1"], {"AD": ("R", "Integer")})
    found = [tuple(r) for r in called.orderBy("lin").select("allele1", "allele2", "phased", "dp", "gq", "format_extra").collect()]
    assert found == [(None, 1, False, 7, 99, '{"AD":[3,2]}'), (1, None, False, None, None, None), (0, 1, True, None, None, None), (1, 2, False, 5, None, None), (1, None, True, None, 3, None)]
    assert "map_from_entries" not in called._jdf.queryExecution().optimizedPlan().toString()


def test_inverted_alleles_are_turned_once(spark):
    from locuskey.plans import catalogue

    plan = catalogue.id_to_hgvs_inv(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") <= 2


def test_contigs_of_documents_are_spelled_once(spark):
    """A contig's bases are a generator's output, which no variant on it works out again; so are its chunks' whole text."""
    from locuskey.plans import inputs
    from locuskey.sources import refgenome

    c = inputs.contigs_of_documents(spark, SF)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(c).count("inline(") == 1
    assert plan(refgenome.from_sequences(c)).count("upper(") == 1
