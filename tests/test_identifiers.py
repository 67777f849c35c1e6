import random

from pyspark.sql import functions as F

from locuskey.functions import alleles, assembly, ids
from locuskey.plans.catalogue import QUERIES
from locuskey.scalar import VariantId, fingerprint

GOLDEN = [
    ("chr1", 100, "A", "G", "GRCh38", "00000064-40800000-00000180-00000000", "4f2fa1aa-00bd-5d29-b9f8-d4917f3f8933"),
    ("chr1", 100, "A", "G", "GRCh37", "00000064-00800000-00000180-00000000", "43723a19-8fbe-5cf7-b54c-16814c394be7"),
    ("chr2", 77, "T", "C", "GRCh38", "0ed6c653-40e00000-00000140-00000000", "2d0c0fcf-eee9-5738-a3b3-9e45c3b7929c"),
    ("chrX", 2000000, "CTGA", "C", "GRCh38", "ab7b8f32-423c0000-00000140-00000000", "f4beddb4-e82c-52aa-b86b-46622799bf08"),
    ("chr1", 1, "A", ".", "GRCh38", "00000001-40800000-00000000-00000000", "d3283120-eb23-59ed-98eb-d61f25fccf74"),
    ("chr1", 100, "N", "G", "GRCh38", "00000064-60000001-00000180-00000000", "6e7c4089-27a7-54f4-b6c8-e331279eeb95"),
    ("chr1", 1, "A" * 21, "C" * 21, "GRCh38", "00000001-60000015-00004000-002abfa8", "2ae1bb99-a2aa-5f97-88ef-f378a1b51961"),
    ("chr1", 1, "ACGT" * 5, "TGCA" * 5, "GRCh38", "00000001-4a0d8d8d-8d8d94e4-e4e4e4e4", "db76c9ba-9b28-51fb-b958-e157f56192bb"),
    ("chr1", 5, "A", "<DEL>", "GRCh38", "00000005-40800000-00004000-000a0000", "1a9d0b2e-3afc-5429-aa9d-a1ea921e4725"),
    ("chr1", 5, "A", "<CNV>", "GRCh38", "00000005-40800000-00004000-000a0040", "d3160c85-6624-55fe-853f-10296f98e364"),
]
FINGERPRINTS = {"A": 0, "C": 1, "G": 2, "T": 3, "ACG": 6, "GCA": 36, "ACGN": 24, "ACGTACGTACGTACGTACGTA": 126257, "ACGT" * 6: 85390, "C" * 21: 49064}


def test_golden_columns(spark):
    df = spark.createDataFrame(GOLDEN, "chrom string, pos long, ref string, alt string, asm string, hex string, uuid string")
    key = ids.encode_key(assembly.chrom_index("chrom"), "pos", "ref", "alt", assembly.parse_assembly("asm"))
    rows = df.withColumn("key", key).select("*", ids.dashed("key").alias("got"), ids.uuid5("key").alias("u")).collect()
    assert [(r.got, r.u) for r in rows] == [(r.hex, r.uuid) for r in rows]


def test_golden_scalar():
    for chrom, pos, ref, alt, asm, text, uuid in GOLDEN:
        v = VariantId.encode(chrom, pos, ref, alt, asm)
        assert (v.to_hex(), v.uuid5()) == (text, uuid)
        assert VariantId.from_hex(text) == v and VariantId.from_int(int(v)) == v


def test_fingerprints(spark):
    df = spark.createDataFrame(list(FINGERPRINTS.items()), "s string, f long")
    assert all(r.f == r.g for r in df.select("f", alleles.fingerprint("s").alias("g")).collect())
    assert all(fingerprint(s) == f for s, f in FINGERPRINTS.items())


def test_fingerprint_query_over_all_documents(spark, tmp_path):
    def slow(raw):
        h = 0
        for b in raw:
            code = {65: 0, 97: 0, 67: 1, 99: 1, 71: 2, 103: 2, 84: 3, 116: 3}.get(b, 0)
            for bit in (code >> 1, code & 1):
                h = h << 1 | bit
                if h >> 17:
                    h ^= 1 << 17 | 9
        return h

    texts = ["", "acgtTGCA" * 9, "Tête à tête, ça gît\n", "straße T", "İ ı ſ t", "日本T語g", "T😀c", "aﬁTG", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in QUERIES["fingerprint"](spark, f"file://{tmp_path}").collect()}
    assert got == {i: None if t is None else slow(t.encode()) for i, t in enumerate(texts)}
    assert all(fingerprint(t) == got[i] for i, t in enumerate(texts) if t is not None)


def test_columns_agree_with_scalar(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        asm = r.choice(assembly.ASSEMBLIES)
        i = r.randrange(25)
        word = lambda: "".join(r.choice("ACGTacgtN") for _ in range(r.choice([1, 2, 5, 19, 20, 21, 40])))  # noqa: B023, E731
        pos = r.choice([1, assembly.LENGTHS[asm][i], r.randint(1, assembly.LENGTHS[asm][i])])
        v = VariantId.encode(assembly.UCSC_NAMES[i], pos, word(), word(), asm)
        rows.append((v.to_hex(), *(v.decode()[k] for k in ("chr", "pos", "ref", "alt", "ref_len", "ref_is_exact", "alt_fingerprint", "assembly"))))
    df = spark.createDataFrame(rows, "hex string, chr string, pos long, ref string, alt string, ref_len int, ref_is_exact boolean, alt_fingerprint int, assembly string")
    got = ids.with_decoded(df.withColumn("key", ids.parse_key("hex"))).collect()
    for x in got:
        assert all(x[k] == x.decoded[k] for k in ("chr", "pos", "ref", "alt", "ref_len", "ref_is_exact", "alt_fingerprint", "assembly"))


def test_order_is_genomic_across_the_sign_bit(spark):
    a, b = VariantId.encode("chr13", 70_440_665, "A", "G"), VariantId.encode("chr13", 70_440_667, "A", "G")
    df = spark.createDataFrame([(b.to_hex(),), (a.to_hex(),)], "h string").withColumn("b", F.unhex(ids.parse_key("h")))
    assert [r.h for r in df.orderBy("b").collect()] == [a.to_hex(), b.to_hex()] and a < b


def test_invalid(spark):
    df = spark.createDataFrame([("", None), ("xyz", None), ("0" * 33, None), ("1f", "0" * 30 + "1f")], "t string, e string")
    assert all(r.e == r.k for r in df.select("e", ids.parse_key("t").alias("k")).collect())
    bad = spark.createDataFrame([(0, 0), (0, 248956423), (25, 1), (None, 1)], "i int, p long")
    assert [r[0] for r in bad.select(ids.encode_key("i", "p", F.lit("A"), F.lit("C"), F.lit(1))).collect()] == [None] * 4
    assert ids.with_decoded(spark.createDataFrame([("f" * 32,)], "key string")).first().decoded is None


def test_linear_ends(spark):
    rows = spark.createDataFrame([(0,), (1,), (491149952,), (3088286401,), (3088286402,)], "x long")
    got = [r[0] for r in rows.select(assembly.linear_index("x", F.lit(1))).collect()]
    assert got == [None, 0, 2, 24, None]


def test_schemes():
    S = assembly.Scheme
    assert [assembly.classify_name(x) for x in ("NC_000001.11", "cm000663.2", "CMX", "Chr1", "1")] == [S.REFSEQ, S.GENBANK, S.BARE, S.UCSC, S.BARE]
    assert assembly.detect_scheme(["1", "chr2"]) == S.UCSC and assembly.detect_scheme([]) == S.BARE and assembly.detect_scheme(["chr1", "CM000663.2"]) == S.GENBANK
    assert assembly.detect_assembly(["##x", "##contig=<ID=1,assembly=hg19>"]) == 0 and assembly.detect_assembly(["##reference=file:///GRCh38.fa"]) == 1
