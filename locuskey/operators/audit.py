"""Audits of identifier sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collisions(rows: DataFrame, key: list[str], alleles: list[str]) -> DataFrame:
    """Keys that stand for more than one set of alleles, with the number of those and of rows.

    Alleles are made distinct per key first and counted after, so no task holds a key's whole set.
    """
    different = rows.groupBy(*key, *alleles).agg(F.count("*").alias("_n"))
    return different.groupBy(*key).agg(F.count("*").alias("n_variants"), F.sum("_n").cast("long").alias("n_rows")).where("n_variants > 1")
