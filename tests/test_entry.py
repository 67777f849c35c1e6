import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"
SAMPLED = ["encode_hex", "decode_fields", "uuid5", "annotate_hex", "vcf_genotypes", "search_sample_join", "search_stored_sites", "search_stored_sample", "sql_functions", "vcf_file_sites", "annotate_vcf_file", "id_to_hgvs", "collision_audit"]


def _rows(table, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in table)


@pytest.mark.parametrize("name", SAMPLED)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    pos = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[i]) for i in pos) for r in want.fetchall()) == _rows(got.collect(), columns)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture
def long_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_search_of_a_stored_collection_prunes(spark, long_plans):
    """Both sides skip buckets, partitions and row groups, and meet bucket by bucket: nothing is shuffled before the join."""
    from locuskey.operators.collection import Collection, search_sites
    from locuskey.plans.catalogue import _CHR13, stored_calls

    stored = stored_calls(spark, DATA)
    region = ("4" * 32, "5" * 32, 0x44444444, 0x44944444)
    plan = search_sites(stored.sites.where("source = 'f1'"), _CHR13)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.partition("PushedFilters: [")[2]
    assert all(x in pushed for x in ("GreaterThanOrEqual(lin,", "LessThanOrEqual(lin,", "GreaterThanOrEqual(key,", "LessThanOrEqual(key,"))
    assert "PartitionFilters: [isnotnull(source" in plan
    again = Collection(spark, stored.path, buckets=99)  # what is there counts
    assert again.buckets == stored.buckets == 4
    again._joining.conf.set("spark.sql.maxMetadataStringLength", 4000)
    join = again.search_sample("f1", "S1", region)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in join and "Exchange" not in join.partition("SortMergeJoin")[2]
    assert join.count("GreaterThanOrEqual(lin,") == 2 and join.count("GreaterThanOrEqual(key,") == 2 and join.count("SelectedBucketsCount: 2 out of 4") == 2
    assert join.count("PartitionFilters: [isnotnull(source") == 2


def test_functions_are_plain_expressions(spark):
    from locuskey.functions.catalogue import FUNCTIONS, register
    from locuskey.scalar import VariantId

    assert register(spark) == [f.name for f in FUNCTIONS]
    one = lambda x: spark.sql(f"SELECT {x} AS x").first().x
    key = VariantId.encode("chr7", 5512, "CA", "T").to_hex()
    assert one("variant_dashed(variant_key('7', 5512, 'CA', 'T', 'hg38'))") == key
    assert one(f"variant_parse('{key}')") == key.replace("-", "") and one("variant_parse('zz')") is None
    assert one("variant_key('chr7', 0, 'C', 'T', 'hg38')") is None and one("variant_key('chr7', 1, 'C', 'T', 'hg99')") is None and one("variant_key('7b', 1, 'C', 'T', 'hg38')") is None
    assert one(f"variant_decode(variant_parse('{key}')).ref") == "CA" and one(f"variant_linear('{key}')") == int(key[:8], 16)
    assert one("hgvs_of(hgvs_key('NC_000007.14:g.5512_5513delCAinsT'))") == "NC_000007.14:g.5512_5513delCAinsT"
    assert one("hgvs_key('NC_000007.14:g.5512del')") is None and one("hgvs_parse('NC_000007.14:c.5A>G').error").startswith("unsupported")
    assert one("hgvs_key(NULL)") is None and one("variant_key(NULL, NULL, NULL, NULL, NULL)") is None and one("variant_decode(NULL)") is None
    plan = spark.sql("SELECT hgvs_of(variant_key('chr' || (id % 22 + 1), id + 1, 'A', 'G', 'hg38')) AS h, variant_uuid(hgvs_key('NC_000007.14:g.' || id || 'A>G')) AS u FROM range(9)")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "UserDefined" not in text
    assert plan.where("h IS NOT NULL AND u IS NOT NULL").count() == 8  # a notation begins at 1
