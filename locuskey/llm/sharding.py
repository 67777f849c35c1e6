"""Sharding by a permutation-filled lookup table.

Shards take turns: each claims the first free slot in its own order of preference over a table with
a prime number of slots. Shares differ by one slot at most, and when a shard is added or
removed few slots change hands. The table's size is fixed, whatever the data, so it can be broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.llm.splits import unused

#: A prime.
SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard index of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or not _is_prime(slots):
        raise ValueError("shards must be different names, not more than slots, and slots a prime")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    start = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    table, at, free = [-1] * slots, list(start), slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return np.array(table, np.int32)


def place(rows: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """All rows with columns slot and shard (a name of ``shards``); the same key always gets the same place.

    A null key has a place as well. Columns of ``rows`` that are named slot or shard are replaced.
    Keys spread evenly; a key that holds many rows keeps them together (give a finer key to spread them).
    """
    spark: SparkSession = rows.sparkSession
    table = lookup_table(shards, slots)
    own = unused(rows.columns, "_slot")
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], f"{own} long, shard string")
    kept = rows.drop("shard").withColumn("slot", F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("slot")), F.lit(slots)))
    return kept.join(F.broadcast(lookup), kept["slot"] == lookup[own], "left").drop(own)


def write_shards(placed: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """One folder per shard; a shard is written by as many tasks as its rows need."""
    n = max(1, placed.sparkSession.sparkContext.defaultParallelism)
    placed.repartition(n, "shard", F.pmod(F.xxhash64("slot"), F.lit(n))).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
