"""Findings of round 3, steps that queries share: what is worked out once, kept nowhere and sorted by what varies."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_annotated_lines_does_not_annotate_again(spark):
    from locuskey.plans import catalogue

    # One for the IDs and one for the ALT alleles, in either half of the query.
    assert _plan(catalogue.annotate_malformed(spark, SF)).count("array_join(") <= 4


def test_keys_of_info_are_cut_once(spark):
    """Each number and type, missing values, undeclared keys, what isn't a number, a flag with a value."""
    from locuskey.sources import vcf

    types = {"DP": ("1", "Integer"), "AF": ("A", "Float"), "DB": ("0", "Flag"), "N": ("1", "String"), "S": (".", "String"), "I": ("2", "Integer"), "Q": ("1", "Float")}
    cases = {
        "DP=3;AF=0.5,.,x;DB": '{"AF":[0.5,null,null],"DB":true,"DP":3}',
        "DP=x;N=a b;S=a,.,\"": '{"DP":null,"N":"a b","S":["a",null,"\\""]}',
        "Z=1,2;I=1,.,2x;Q=1e3;Y;DB=0": '{"DB":true,"I":[1,null,null],"Q":1000.0,"Y":true,"Z":"1,2"}',
        ".": "{}",
        "N=;;B=.": '{"B":null,"N":""}',
    }
    e = vcf.info_json(F.col("i"), types)
    found = spark.createDataFrame([(x,) for x in cases], "i string").select("i", e.alias("j"), vcf.info_json(F.col("i"), {}).alias("plain")).collect()
    assert {r.i: r.j for r in found} == cases
    assert found[0].plain == '{"AF":"0.5,.,x","DB":true,"DP":"3"}'
    assert str(e).count("substring_index") == 1


def test_written_lines_are_made_once(spark, tmp_path):
    from locuskey.sources.bgzf import write_file
    from locuskey.sources.vcf import data_lines, read_lines

    made = spark.sparkContext.accumulator(0)

    def make(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame.assign(value=["line%d" % x for x in frame["id"]])[["value", "row"]]

    rows = spark.range(3000).select("id", F.hash("id").cast("long").alias("row"))
    lines = rows.mapInPandas(make, "value string, row long")
    for name in ("a.vcf", "a.vcf.gz"):
        path, before = str(tmp_path / name), made.value
        write_file(lines, ["#h"], path, ("row",), spread=(-(1 << 31), (1 << 31) - 1), compress=name.endswith("gz"))
        assert made.value - before == 3000
        got = data_lines(read_lines(spark, path, name.endswith("gz"))).orderBy("block", "row").collect()
        assert [r.value for r in got] == [f"line{r.id}" for r in rows.orderBy("row").collect()]


def test_stored_files_are_not_sampled(spark, monkeypatch):
    from locuskey.plans import files

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    files.stored_file(spark, SF, "vcf")


def test_carriage_returns_are_cut_where_there_are_any(spark):
    from locuskey.sources.bgzf import without_returns

    found = spark.createDataFrame([("a\r\rb\r\r",), ("a\rb",), ("\r",), ("",), (None,)], "t string").select(without_returns("t").alias("t")).collect()
    assert [r.t for r in found] == ["a\r\rb", "a\rb", "", "", None]


def test_an_added_file_is_kept_nowhere_else(spark, monkeypatch):
    from locuskey.plans import files

    monkeypatch.setattr(type(spark.range(1)), "persist", None)
    assert files.add_vcf_file(spark, SF).count()


def test_firsts_are_sorted_by_the_key_that_varies(spark):
    from locuskey.operators.collection import insert_or_ignore

    rows = spark.createDataFrame([("f", "k1", 2, "b"), ("f", "k1", 1, "a"), ("f", "k2", 1, "c"), ("g", "k1", 5, "d"), (None, "k1", 1, "n")], "source string, key string, row int, x string")
    fresh = insert_or_ignore(rows.where("key = 'k2'"), rows, ["source", "key"], ["row"])
    assert fresh.columns == rows.columns
    assert {tuple(r) for r in fresh.collect()} == {("f", "k1", 1, "a"), ("g", "k1", 5, "d"), (None, "k1", 1, "n")}
    assert "Aggregate [key#" in _plan(fresh)
