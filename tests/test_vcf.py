import gzip
import io
import json

import pytest
from pyspark.sql import functions as F

from locuskey import VariantId, cli
from locuskey.functions.assembly import AssemblyNotDetectedError
from locuskey.operators.annotate import annotate_file
from locuskey.operators.collection import Collection
from locuskey.sources import bgzf, refgenome
from locuskey.sources.vcf import parse_structured, read_header

VCF = """##fileformat=VCFv4.3
##INFO=<ID=SB,Number=1,Type=Float,Description="Strand balance, a share">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Calls of each allele">
##INFO=<ID=HOT,Number=0,Type=Flag,Description="Known site">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Call">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Confidence">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Reads">
##contig=<ID=chr7,length=159345973>
##contig=<ID=chr12>
##contig=<ID=chrX>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tleft\tright
chr7\t5511\trs7\tT\tTCA\t71.5\tPASS\tSB=0.25;HOT\tGT:GQ:DP\t0|1:44:12\t0/0:50:9
chr7\t90210\t.\tGC\tG,GT\t.\tq9;s3\tAC=2,1\tGT:DP:GQ\t1/2:33:.\t./.
chr12\t41\t.\tN\tA\t3\t.\t.\tGT\t0/0\t0|0
chrX\t8000\tq\tC\tA\t12\tPASS\tSB=1\tGT:GQ:DP\t1:8:2\t0:9:3
"""
#: What the records make: (contig, position, REF, ALT) in order.
ALLELES = [("chr7", 5511, "T", "TCA"), ("chr7", 90210, "GC", "G"), ("chr7", 90210, "GC", "GT"), ("chr12", 41, "N", "A"), ("chrX", 8000, "C", "A")]
IDS = [VariantId.encode(*x, "GRCh38").to_hex() for x in ALLELES]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "sample.vcf"
    p.write_text(VCF)
    return str(p)


def test_header(spark, source):
    header, zipped = read_header(spark, source)
    assert not zipped and header.samples == ["left", "right"] and header.contig_ids == ["chr7", "chr12", "chrX"]
    assert header.types["INFO"]["AC"] == ("A", "Integer") and json.loads(header.definitions_json("contig"))[0] == {"id": "chr7", "length": 159345973}
    assert parse_structured('##INFO=<ID=X,Description="a, \\"b\\"">')["Description"] == 'a, "b"'


def test_collection(spark, source, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    for _ in range(2):
        c.add_vcf(source)
    # The first record has one call that is not homozygous reference, the second two of each sample, the last two haploid ones.
    assert c.sites.count() == len(ALLELES) and c.genotypes.count() == 1 + 4 + 2
    assert c.list_samples() == ["sample__left", "sample__right"] and len(c.list_sources()) == 1
    hits = c.search_region("sample__left", "chr7", 5512, 100_000).collect()
    assert [(r.variant_id, r.allele1, r.allele2, r.phased, r.dp, r.gq, r.qual) for r in hits] == [(i, 1, 2, False, 33, None, None) for i in IDS[1:3]]
    sites = c.search_region("sample__sites", "7", 90210, 90210).collect()
    assert sites[0].info == '{"AC":[2,1]}' and sites[0].multiallelic and sites[0].filter == "q9;s3"
    assert [r.info for r in c.search_region("sample__sites", "chr7", 1, 6000).collect()] == ['{"HOT":true,"SB":0.25}']
    alone = c.search_region("sample__right", "chrX", 1, 9000).collect()
    assert [(r.variant_id, r.allele1, r.allele2, r.dp, r.gq) for r in alone] == [(IDS[4], 0, None, 3, 9)]
    with pytest.raises(OSError):
        c.search_region("sample__sites", "chr1", 1, 10**9)
    with pytest.raises(ValueError):
        c.search_region("sample__sites", "chrQ", 1, 2)
    assert c.sql("select count(*) as n from sites").first().n == len(ALLELES)
    found = c.sql("select distinct variant_dashed(lower(hex(key))) as id from sites where key between unhex(region_low('chr7', 1, 100000, 'hg38')) and unhex(region_high('chr7', 1, 100000, 'hg38'))")
    assert {r.id for r in found.collect()} == set(IDS[:3])


def test_annotate(spark, source, tmp_path):
    with pytest.raises(AssemblyNotDetectedError):
        annotate_file(spark, source, str(tmp_path / "x.vcf"))
    assert annotate_file(spark, source, str(tmp_path / "o.vcf"), assembly="hg38") == 4
    lines = (tmp_path / "o.vcf").read_text().splitlines()
    assert lines[:11] == VCF.splitlines()[:11]
    assert [x.split("\t")[2] for x in lines[11:]] == [IDS[0], f"{IDS[1]}_{IDS[2]}", IDS[3], IDS[4]]
    assert annotate_file(spark, source, str(tmp_path / "o.vcf.gz"), assembly="38", use_uuid=True) == 4
    data = (tmp_path / "o.vcf.gz").read_bytes()
    assert data.endswith(bgzf.EOF_BLOCK) and gzip.decompress(data).decode().count("\n") == 15


def test_annotate_odd_lines(spark, tmp_path):
    p = tmp_path / "odd.bin"
    body = "##reference=GRCh38\n#CHROM\tPOS\tID\tREF\tALT\nchr1\t0100\trs\tA\t<DEL>, G\nchrQ\t5\trs\tA\tG\nshort\tline\n\nchr1\t7\trs\tA\t.\r\n"
    p.write_bytes(gzip.compress(body.encode()))
    assert annotate_file(spark, str(p), str(tmp_path / "odd.vcf")) == 4
    out = (tmp_path / "odd.vcf").read_text().splitlines()[2:]
    assert out == ["chr1\t100\t._00000064-40800000-00000180-00000000\tA\t<DEL>,G", "chrQ\t5\trs\tA\tG", "short\tline", "chr1\t7\t.\tA\t."]


def test_cli(spark, source, tmp_path, capsys):
    assert cli.main(["encode", "chr1", "100", "A", "G"]) == 0
    assert capsys.readouterr().out.strip() == "00000064-40800000-00000180-00000000"
    assert cli.main(["decode", "00000064-40800000-00000180-00000000"]) == 0
    assert "pos: 100" in capsys.readouterr().out
    assert cli.main(["encode", "chrQ", "1", "A", "G"]) == 1 and cli.main(["vcf", "/no/such"]) == 1
    assert cli.main(["add", str(tmp_path / "k"), source]) == 0 and cli.main(["info", str(tmp_path / "k")]) == 0
    assert "sites: 5" in capsys.readouterr().out
    assert cli.main(["search", str(tmp_path / "k"), "sample__left", "chr7", "1-6000"]) == 0
    assert capsys.readouterr().out.count("\n") == 2
    assert cli.main(["hgvs-encode", "NC_000001.11:g.60411A>G"]) == 0
    assert capsys.readouterr().out.strip() == "0000ebfb-40800000-00000180-00000000"
    assert cli.main(["hgvs-decode", "0000ebfb-40800000-00000180-00000000"]) == 0
    assert capsys.readouterr().out.strip() == "NC_000001.11:g.60411A>G"


def test_fetch(tmp_path):
    p = cli.fetch_genome("GRCh38", tmp_path, lambda url: io.BytesIO(b"x"))
    assert p.read_bytes() == b"x" and not list(tmp_path.glob("*.partial"))


def test_setup_and_the_offer_of_a_genome(spark, source, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LOCUSKEY_DATA_DIR", str(tmp_path / "genomes"))
    got = []
    monkeypatch.setattr(cli, "fetch_genome", lambda name: got.append(name) or name)
    assert cli.main(["setup"]) == 0 and got == ["GRCh38", "GRCh37"]
    assert cli.main(["setup", "--assembly", "hg19"]) == 0 and got.pop() == "GRCh37"
    assert cli.main(["setup", "--assembly", "hg38", "--assembly", "hg99"]) == 1 and len(got) == 2
    # Without a terminal the user is told what to do; at one they are asked.
    argv = ["vcf", source, "--output", str(tmp_path / "n.vcf"), "--normalize", "--assembly", "GRCh37"]
    assert cli.main(argv) == 1
    assert "locuskey setup --assembly GRCh37" in capsys.readouterr().err
    lacking = refgenome.ReferenceNotFoundError("none", "GRCh37")
    monkeypatch.setattr(cli.sys, "stdin", type("Terminal", (), {"isatty": lambda self: True})())
    for answer, there in (("", True), ("YES", True), ("n", False), ("what", False)):
        asked = []
        assert cli.offer_genome(lacking, lambda q: asked.append(q) or answer, got.append) is there and len(asked) == 1  # noqa: B023
    assert got[2:] == ["GRCh37"] * 2
    assert not cli.offer_genome(refgenome.ReferenceNotFoundError("none"), lambda q: "y", got.append)


def test_stream(spark, source, tmp_path):
    from locuskey.functions.assembly import Scheme
    from locuskey.streaming import annotate_stream, ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    stream = annotate_stream(spark, str(tmp_path / "in"), Scheme.UCSC, 1).withColumn("key", F.split("value", "\t")[2])
    q = ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["key"], ["value"]).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_malformed_line_of_every_row(spark):
    from locuskey.plans import catalogue, inputs

    data = "/root/testdata/sf0.001"
    assert catalogue.annotate_malformed(spark, data).where("head like 'broken%'").count() == inputs.vcf_lines(spark, data).count()


def test_ingest_reads_the_batch_s_ranges_alone(spark, tmp_path):
    """Files of other ranges are broken between the batches: nobody looks."""
    from locuskey.streaming import ingest_stream, stored_ranges, with_range

    schema = "key string, lin long, note string"
    rows = lambda name, *lins: spark.createDataFrame([(f"k{x}", x, name) for x in lins], schema).write.mode("append").parquet(str(tmp_path / "in"))

    def ingest():
        stream = with_range(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), ["key"], ["note"], by="range").trigger(availableNow=True).start().awaitTermination()

    far = 1 << 30
    rows("a", 5, 6, 6, far, far + 1)
    ingest()
    broken = [f for f in (tmp_path / "out" / f"range={far >> 22}").glob("*.parquet")]
    kept = {f: f.read_bytes() for f in broken}
    for f in broken:
        f.write_bytes(b"broken")
    rows("b", 6, 7)
    ingest()
    plan = stored_ranges(spark, str(tmp_path / "out"), [0], with_range(spark.createDataFrame([], schema)).schema, "range")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in plan
    for f, data in kept.items():
        f.write_bytes(data)
    rows("c", far, 8)
    ingest()
    got = sorted((r.key, r.note) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([("k5", "a"), ("k6", "a"), (f"k{far}", "a"), (f"k{far + 1}", "a"), ("k7", "b"), ("k8", "c")])


def test_sets_of_many_sources(spark):
    from locuskey.operators.sets import Members, members_of

    names = [f"s{i:03d}" for i in range(150)]
    rows = [(k, n) for k in range(40) for i, n in enumerate(names) if (i * 7 + k * k) % (k + 2) == 0] + [(3, None), (None, "s001"), (3, "other")]
    df = spark.createDataFrame(rows * 2, "key int, source string")
    m = Members(names)
    got = m.of(df, ["key"])
    some = names[60:70]
    asked = got.select("key", "n_sources", m.any_of(*some).alias("a"), m.all_of("s000", "s063", "s126").alias("b"), m.only_in("s001").alias("c"), m.none_of(*some).alias("d"), m.at_least(4, *some).alias("e"), m.all_of().alias("f"), m.any_of().alias("g"), m.count(*some).alias("h"))
    assert asked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    have = {}
    for k, n in rows:
        if n in names:
            have.setdefault(k, set()).add(n)
    want = {k: (len(s), bool(s & {*some}), s >= {"s000", "s063", "s126"}, s == {"s001"}, not s & {*some}, len(s & {*some}) >= 4, True, False, len(s & {*some})) for k, s in have.items()}
    assert {r.key: tuple(r)[1:] for r in asked.collect()} == want
    assert members_of(df.where("key = 3")).sources == sorted({n for k, n in rows if k == 3 and n})
    assert Members([]).of(df, ["key"]).count() == 0
    with pytest.raises(ValueError):
        m.any_of("nobody")
    with pytest.raises(ValueError):
        Members(["a", "a"])
