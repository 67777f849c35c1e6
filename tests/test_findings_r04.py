"""Finding of round 4 on long spans: a span's bases come by one join from whole sequences, and its fingerprints by batch."""

import pyarrow as pa
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_long_spans_need_no_chunks(spark):
    from locuskey.plans import catalogue

    plan = catalogue.hgvs_long_spans(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "collect_list" not in plan


def test_spans_of_whole_sequences_are_those_of_chunks(spark):
    """Spans at and over the edges, bases of other cases, characters of several bytes, an unknown contig; long alleles by batch."""
    from locuskey.operators.hgvs_convert import hgvs_to_id
    from locuskey.sources import refgenome

    texts = {"a": "GATTACA" * 3000, "b": "acgtn" * 900, "c": "é中ACGT" * 1000, "d": "", "e": None}
    whole = spark.createDataFrame(list(texts.items()), "contig string, seq string")
    spans = [(1, 1), (2, 40), (2, 6001), (4000, 4200), (90, 20), (4499, 4500), (4499, 4501), (5, 21000), (20990, 21001)]
    marks = [f"NC_000001.11:g.{a}_{b}{edit}" for a, b in spans for edit in ("del", "inv", "dup", "delinsT")]
    rows = spark.createDataFrame([(k, m) for k in [*texts, "none", None] for m in marks], "k string, hgvs string")
    ask = lambda reference, **more: {tuple(map(str, r)) for r in hgvs_to_id(rows, reference=reference, contig="k", **more).collect()}
    want = ask(refgenome.from_sequences(whole.where("length(seq) > 0")))
    assert len(want) == 7 * len(marks)
    assert ask(whole) == want and ask(whole, long_alleles=True) == want


def test_fingerprints_by_batch(spark):
    from locuskey.functions import alleles
    from locuskey.scalar import fingerprint

    texts = ["", "A", "t" * 19, None, "GATTACA" * 3, "ACGTN" * 8, "123-é\n𝄞 acgt" * 5, "GGTCA" * 30000, "C" * 140000]
    want = [None if x is None else fingerprint(x) for x in texts]
    assert alleles.fingerprints(pa.array(texts)).to_pylist() == want
    assert alleles.fingerprints(pa.array(texts)[3:]).to_pylist() == want[3:]
    assert alleles.fingerprints(pa.array([None], pa.string())).to_pylist() == [None]
    assert alleles.fingerprints(pa.array([], pa.string())).to_pylist() == []
