"""Columns with the names that operators use themselves, and ties of ids of all types."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from locuskey.llm import bm25, langid, quality, warc
from locuskey.llm.sharding import SLOTS, lookup_table, place
from locuskey.llm.textkernel import PRIME, times

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("pad", ["_pad", "_PAD"])
def test_padding_columns(spark, pad):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn(pad, F.col("doc_id") + 1)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.where(F.col(pad) == F.col("doc_id") + 1).count() == docs.count()
    named = langid.label(docs, langid.fit(docs))
    assert named.where(F.col(pad) == F.col("doc_id") + 1).count() == docs.count()


def test_slot_columns(spark):
    rows = spark.range(50).selectExpr("id as doc_id", "id * 2 as _slot", "'mine' as shard")
    placed = place(rows, ["a", "b", "c"])
    assert placed.columns == ["doc_id", "_slot", "slot", "shard"]
    assert placed.where("_slot = doc_id * 2 and shard in ('a', 'b', 'c')").count() == 50
    assert {r.doc_id: r.shard for r in placed.collect()} == {r.doc_id: r.shard for r in place(rows.drop("_slot"), ["a", "b", "c"]).collect()}


@pytest.mark.parametrize(("kind", "ids"), [("decimal(10,0)", [Decimal(9), Decimal(10), Decimal(11), Decimal(100), None]), ("string", ["Z", "a", "é", "𐀀", None]), ("int", [-5, 9, 10, 100, None]), ("date", None)])
def test_ties_go_by_the_ids_type(spark, kind, ids):
    import datetime

    ids = ids or [datetime.date(999, 1, 1), datetime.date(2000, 1, 1), datetime.date(2000, 1, 2), None]
    docs = spark.createDataFrame([(i, "same words here") for i in reversed(ids)], f"doc_id {kind}, text string").repartition(2)
    queries = spark.createDataFrame([(ids[0], "words")], f"doc_id {kind}, text string")
    for k in (2, len(ids)):
        got = bm25.search(docs, queries, k=k, shard_bytes=20).orderBy("rank").collect()
        assert [r.doc_id for r in got] == ids[:k]


def test_lookup_table_against_whole_permutations():
    """Each shard's order of preference is written out whole; shards take their next free slot in turn."""
    import hashlib

    for names, slots in ((["a", "b", "c"], 13), ([f"shard-{i}" for i in range(7)], 101), (["x"], 5), (["p", "q"], 2)):
        orders = []
        for name in names:
            d = hashlib.sha256(name.encode()).digest()
            start, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1
            orders.append([(start + i * step) % slots for i in range(slots)])
            assert sorted(orders[-1]) == list(range(slots))
        owner = {}
        while len(owner) < slots:
            for i, order in enumerate(orders):
                if len(owner) < slots:
                    owner[next(s for s in order if s not in owner)] = i
        assert lookup_table(names, slots).tolist() == [owner[s] for s in range(slots)]


def test_rows_lie_where_the_table_says(spark):
    names = [f"s{i}" for i in range(5)]
    rows = place(spark.range(3000).withColumnRenamed("id", "doc_id"), names).withColumn("want", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOTS))).collect()
    table = lookup_table(names)
    assert all(r.slot == r.want and r.shard == names[table[r.slot]] for r in rows)
    sizes = [sum(r.shard == n for r in rows) for n in names]
    assert max(sizes) < 1.3 * min(sizes)


def test_products_modulo_a_prime():
    import numpy as np

    r = np.random.RandomState(1)
    p = int(PRIME)
    a, b = (np.concatenate([r.randint(0, p, 500), [0, 1, p - 1, p - 1, 2**32, 2**32 - 1]]).astype(np.uint64) for _ in range(2))
    assert times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]


def test_pages_of_one_payload_lie_in_several_tasks(spark):
    """A third of all pages is empty: their records are in many archives, one of them the response."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("page "), F.col("id").cast("string"))).alias("html"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.write_archives(pages)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    empty = index.where("page_id % 3 = 0").groupBy("archive").count().collect()
    assert len(empty) > 1 and max(r["count"] for r in empty) < 800
    got = {r.page_id: r for r in warc.resolve_revisits(warc.read_archives(index)).collect()}
    assert len(got) == 3000 and all(got[i].refers_to == (2997 if i % 3 == 0 and i != 2997 else None) for i in got)
    assert all(got[i].payload_bytes == (0 if i % 3 == 0 else len(f"page {i}")) for i in got)
