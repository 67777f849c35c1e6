import random
import struct

import pytest
from pyspark.sql import functions as F

from locuskey.functions import hgvs
from locuskey.operators.hgvs_convert import hgvs_to_id, id_to_hgvs
from locuskey.operators.normalize import normalize
from locuskey.scalar import VariantId
from locuskey.sources import refgenome


def slow(pos, ref, alt, seq):
    """Trim and shift one base at a time."""
    while True:
        before = (pos, ref, alt)
        while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
            ref, alt = ref[:-1], alt[:-1]
        while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
            pos, ref, alt = pos + 1, ref[1:], alt[1:]
        while min(len(ref), len(alt)) == 1 and ref[-1] == alt[-1] and pos > 1:
            base = seq[pos - 2]
            pos, ref, alt = pos - 1, base + ref[:-1], base + alt[:-1]
        if (pos, ref, alt) == before:
            return before


def test_against_stepwise(spark):
    r = random.Random(1)
    contigs = {f"c{i}": "".join(r.choice("AC" if i % 2 else "ACGT") for _ in range(300)) for i in range(6)} | {"long": "A" * 1500 + "CAG" * 400}
    rows = []
    for i in range(400):
        name = r.choice(list(contigs))
        seq = contigs[name]
        pos, n = r.randint(1, len(seq) - 12), r.randint(1, 6)
        word = "".join(r.choice("ACGT") for _ in range(r.randint(1, 5)))
        ref = seq[pos - 1 : pos - 1 + n]
        alt = r.choice([ref[0], ref[0] + word, word, ref + ref[-1], ref[0] + ref])
        if ref != alt:
            rows.append((i, name, pos, ref, alt, *slow(pos, ref, alt, seq)))
    df = spark.createDataFrame(rows, "i int, contig string, pos long, ref string, alt string, p long, r string, a string")
    reference = refgenome.from_dict(spark, contigs, chunk=700, lookback=600)
    got = normalize(df, reference, chunk=700).collect()
    assert len(got) == len(rows)
    assert [(x.norm_pos, x.norm_ref, x.norm_alt) for x in got] == [(x.p, x.r, x.a) for x in got]


def test_symbolic_and_missing(spark):
    df = spark.createDataFrame([("c", 3, "A", "<DEL>"), ("c", 3, "A", "*"), ("c", 3, "", "A"), ("none", 9, "AA", "A"), ("c", 3, "AA", "A")], "contig string, pos long, ref string, alt string")
    got = normalize(df, refgenome.from_dict(spark, {"c": "AAACGT"})).orderBy("contig", "alt", "ref").collect()
    by = {(x.contig, x.ref, x.alt): x for x in got}
    assert not any(by[k].was_modified for k in by if k != ("c", "AA", "A"))
    x = by["c", "AA", "A"]
    assert (x.norm_pos, x.norm_ref, x.norm_alt, x.was_modified) == (1, "AA", "A", True)
    assert by["none", "AA", "A"].norm_error and by["c", "A", "*"].norm_error is None


def test_reference_files(spark, tmp_path, monkeypatch):
    seq = "ACGTNNACGTTTGACCA"
    (tmp_path / "g.fa").write_text(">chr1 x\nACGTNN\nACGTTT\nGACCA\n")
    (tmp_path / "g.fa.fai").write_text("chr1\t17\t8\t6\t7\n")
    bits = "".join(f"{'TCAG'.find(c) if c != 'N' else 0:02b}" for c in seq).ljust(40, "0")
    packed = int(bits, 2).to_bytes(5, "big")
    record = struct.pack("<IIIIII", 17, 1, 4, 2, 0, 0) + packed
    head = struct.pack("<4I", 0x1A412743, 0, 1, 0) + b"\x04chr1" + struct.pack("<I", 25)
    (tmp_path / "g.2bit").write_bytes(head + record)
    for name in ("g.fa", "g.2bit"):
        table = refgenome.open_reference(spark, tmp_path / name)
        assert [r.seq for r in table.collect()] == [seq]
    small = {"chunk": 3, "lookback": 2}
    want = refgenome.from_dict(spark, {"chr1": seq}, **small).orderBy("chunk").collect()
    monkeypatch.setattr(refgenome, "RANGE", 2)
    for table in (refgenome.from_fasta(spark, str(tmp_path / "g.fa"), **small), refgenome.from_twobit(spark, str(tmp_path / "g.2bit"), **small)):
        assert table.orderBy("chunk").collect() == want and table.select(F.spark_partition_id()).distinct().count() > 1
    rows = spark.createDataFrame([("chr1", 2, 5), ("chr1", 15, 18), ("chr2", 1, 1)], "c string, a long, b long")
    got = refgenome.with_bases(rows, refgenome.open_reference(spark, tmp_path / "g.fa"), "c", F.col("a"), F.col("b")).orderBy("c", "a").collect()
    assert [r.bases for r in got] == ["CGTN", None, None]
    assert refgenome.find_reference("g", tmp_path).name == "g.2bit"


def test_hgvs_roundtrip(spark):
    texts = ["NC_000001.11:g.731_733delGTC", "NC_000001.11:g.730_731insCAT", "NC_000001.11:g.640_642delCATinsGA", "NC_000001.11:g.55=", "NC_000001.11:g.5_9dup", "NC_000001.11:g.5_9inv", "NC_012920.1:m.310T>C"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", hgvs.parse("t"))
    assert [r[0] for r in df.select(hgvs.render("v")).collect()] == texts
    bad = ["NM_1:g.1A>G", "NC_000001.11", "NC_000001.11:c.1A>G", "NC_000001.11:g.A>G", "NC_000001.11:g.5", "NC_000001.11:g.5delX"]
    df = spark.createDataFrame([(t,) for t in bad], "t string").select(hgvs.parse("t").alias("v"))
    assert all(r.v.error and r.v.edit is None for r in df.collect())


def test_hgvs_to_id(spark):
    seq = "C" * 37 + "GATTCAGGT" + "T" * 60
    reference = refgenome.from_dict(spark, {"chr5": seq})
    want = {
        "NC_000005.10:g.39_42del": (38, "GATTC", "G"),
        "NC_000005.10:g.43_44insCCTA": (43, "A", "ACCTA"),
        "NC_000005.10:g.40_43delinsGG": (40, "TTCA", "GG"),
        "NC_000005.10:g.38_39dup": (39, "A", "AGA"),
        "NC_000005.10:g.42_46inv": (42, "CAGGT", "ACCTG"),
        "NC_000005.10:g.41=": (41, "T", "T"),
    }
    df = spark.createDataFrame([(t,) for t in want], "hgvs string")
    for r in hgvs_to_id(df, reference=reference).collect():
        assert (r.pos, r.ref, r.alt) == want[r.hgvs] and r.key == VariantId.encode("chr5", *want[r.hgvs]).to_hex().replace("-", "")
    alone = {r.hgvs: r.error for r in hgvs_to_id(df).collect()}
    assert set(alone.values()) == {"reference required"}
    odd = spark.createDataFrame([("NC_000031.1:g.7A>G",), ("NC_000005.9:g.812T>C",)], "hgvs string")
    assert {r.hgvs: r.error for r in hgvs_to_id(odd, expected=1).collect()} == {"NC_000031.1:g.7A>G": "unknown accession", "NC_000005.9:g.812T>C": "assembly mismatch"}
    keys = spark.createDataFrame([(VariantId.encode("chr5", 38, "GATTC", "G").to_hex(),), (VariantId.encode("chr5", 43, "A", "ACCTA").to_hex(),)], "h string").withColumn("key", F.regexp_replace("h", "-", ""))
    assert [r.hgvs for r in id_to_hgvs(keys).collect()] == ["NC_000005.10:g.39_42delATTC", "NC_000005.10:g.43_44insCCTA"]


def test_hgvs_to_id_over_several_chunks(spark):
    r = random.Random(5)
    seq = "".join(r.choice("ACGT") for _ in range(1010))
    reference = refgenome.from_dict(spark, {"chr1": seq}, chunk=100, lookback=10)
    back = {"A": "T", "C": "G", "G": "C", "T": "A"}
    want = {}
    for _ in range(40):
        a = r.randint(2, 990)
        b = r.randint(a + 1, 1010)
        x = seq[a - 1 : b]
        name = f"NC_000001.11:g.{a}_{b}"
        want |= {
            f"{name}del": (a - 1, seq[a - 2] + x, seq[a - 2]),
            f"{name}del{x}": (a - 1, seq[a - 2] + x, seq[a - 2]),
            f"{name}delinsTT": (a, x, "TT"),
            f"{name}dup": (b, seq[b - 1], seq[b - 1] + x),
            f"{name}dup{x}": (b, seq[b - 1], seq[b - 1] + x),
            f"{name}inv": (a, x, "".join(back[c] for c in reversed(x))),
        }
    outside = {f"NC_000001.11:g.{a}_{b}inv" for a, b in ((500, 1011), (500, 9_000_000_000_000_000_000), (5000, 9000), (900, 300))}
    df = spark.createDataFrame([(t,) for t in [*want, *want, *outside]], "hgvs string")
    rows = hgvs_to_id(df, reference=reference, chunk=100).collect()
    assert len(rows) == df.count()
    for x in rows:
        if x.hgvs in outside:
            assert (x.error, x.key) == ("reference required", None)
        else:
            assert x.error is None and (x.pos, x.ref, x.alt) == want[x.hgvs] and x.key == VariantId.encode("chr1", *want[x.hgvs]).to_hex().replace("-", "")


def test_long_repeats_are_one_plan(spark):
    """Runs of many periods over many chunks, alleles longer than the window and than a chunk, against one step after the other."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    unit = word(70)
    contigs = {
        "mono": word(30) + "A" * 900 + word(20),
        "all": "AC" * 300,
        "tri": "G" + "CAG" * 350 + word(9),
        "unit": word(40) + unit * 9 + word(30),
        "unknown": "N" * 400 + word(50),
        "two": "A" * 200 + "C" + "A" * 333 + "T",
    }
    rows = []
    for name, seq in contigs.items():
        for _ in range(25):
            pos, n = r.randint(2, len(seq) - 80), r.choice([1, 2, 3, 6, 69, 70, 140])
            span = seq[pos : pos + n]
            ref, alt = r.choice([(seq[pos - 1], seq[pos - 1] + span), (seq[pos - 1] + span, seq[pos - 1])])
            if len(ref) != len(alt):
                rows.append((len(rows), name, pos, ref, alt, *slow(pos, ref, alt, seq)))
    rows.append((len(rows), "mono", 400, "A", "A", 1, contigs["mono"][0], contigs["mono"][0]))
    df = spark.createDataFrame(rows, "i int, contig string, pos long, ref string, alt string, p long, r string, a string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    out = normalize(df, refgenome.from_dict(spark, contigs, chunk=64, lookback=50), chunk=64)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryRelation" not in plan and "InMemoryTableScan" not in plan and len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    got = out.orderBy("i").collect()
    assert [(x.i, x.norm_pos, x.norm_ref, x.norm_alt, x.norm_error) for x in got] == [(x[0], *x[5:], None) for x in rows]
    assert sum(x.pos - x.norm_pos > 200 for x in got) > 20


def test_kinds_of_errors(spark):
    reference = refgenome.from_dict(spark, {"c": "ACGTACGTAA"})
    df = spark.createDataFrame([(1, "c", 10, "A", "AA"), (2, "d", 5, "A", "AA"), (3, "c", 40, "A", "AA"), (4, None, 4, "TT", "T"), (5, "d", 5, "A", "G")], "i int, contig string, pos long, ref string, alt string")
    got = {r.i: r for r in normalize(df, reference).collect()}
    assert (got[1].norm_pos, got[1].norm_error, got[5].norm_error) == (8, None, None)
    assert [got[i].norm_error for i in (2, 3, 4)] == ["contig not in the reference: d:5", "position outside the contig: c:40", "contig not in the reference: null:4"]
    assert [(got[i].norm_pos, got[i].was_modified) for i in (2, 3, 4)] == [(5, False), (40, False), (4, False)]
    for i, what in ((2, "contig not in the reference"), (3, "position outside the contig")):
        with pytest.raises(Exception, match=what):
            normalize(df.where(f"i = {i}"), reference, strict=True).collect()


def test_error_codes_and_strict(spark):
    from locuskey.plans.catalogue import hgvs_indel_to_id

    want = {"NC_000001.11": "no_colon", "NM_1:g.1A>G": "not_refseq", "NC_000001.11:5": "no_system", "NC_000001.11:n.1A>G": "unsupported_system", "NC_000001.11:z.1A>G": "unknown_system", "NC_000001.11:g.A>G": "no_position", "NC_000001.11:g.5": "unknown_edit", "NC_000031.1:g.5A>G": "unknown_accession", "NC_000001.10:g.5A>G": "assembly_mismatch", "NC_000001.11:g.5dup": "reference_required", "NC_012920.1:m.99999A>G": "outside_contig", None: "null", "NC_000001.11:g.5A>G": None}
    assert set(want.values()) - {None} == set(hgvs.ERRORS)
    df = spark.createDataFrame([(x,) for x in want], "hgvs string")
    assert {r.hgvs: r.error_code for r in hgvs_to_id(df, expected=1).collect()} == want
    for text, code in want.items():
        one = hgvs_to_id(df.where(F.col("hgvs").eqNullSafe(F.lit(text))), expected=1, strict=True)
        if code is None:
            assert one.first().key
        else:
            with pytest.raises(Exception, match=f"{code}: "):
                one.collect()
    plan = hgvs_indel_to_id(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 30
