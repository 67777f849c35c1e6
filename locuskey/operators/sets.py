"""Set algebra over keys of many sources: one aggregate, a bit for each source.

Which sources have a key is a row of 64-bit words, or-ed together before and after the one shuffle, so a key that all sources repeat travels once a
task. Every question about sets of sources is then a filter on that row: no join, and no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of a word: a bigint's bits but the sign.
WORD = 63


class Members:
    """The sources and the places of their bits."""

    def __init__(self, sources: list[str], column: str = "members"):
        if len(set(sources)) != len(sources):
            raise ValueError("a source is named twice")
        self.sources, self.column = list(sources), column
        self._place = {s: divmod(i, WORD) for i, s in enumerate(sources)}
        self.words = max(1, -(-len(sources) // WORD))

    def _masks(self, names) -> list[int]:
        masks = [0] * self.words
        for n in names:
            if n not in self._place:
                raise ValueError(f"unknown source: {n}")
            word, bit = self._place[n]
            masks[word] |= 1 << bit
        return masks

    def _word(self, i: int) -> Column:
        return F.get(F.col(self.column), F.lit(i))

    def of(self, rows: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
        """A row for each key that a source has: the keys, ``members`` (array of words) and n_sources. Rows of other sources, and of none, count for nothing."""
        places = F.create_map(*[F.lit(x) for i, s in enumerate(self.sources) for x in (s, i)]) if self.sources else F.create_map().cast("map<string,int>")
        placed = rows.select(*keys, F.element_at(places, F.col(source)).alias("_i")).where("_i is not null")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_i") % WORD).cast("int"))
        words = [F.bit_or(F.when(F.floor(F.col("_i") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(self.words)]
        found = placed.groupBy(*keys).agg(*[x.alias(f"_w{i}") for i, x in enumerate(words)])
        return found.select(*keys, F.array(*[f"_w{i}" for i in range(self.words)]).alias(self.column)).withColumn("n_sources", self.count())

    def count(self, *names: str) -> Column:
        """How many of some sources, or of all, have a key."""
        masks = self._masks(names or self.sources)
        parts = [F.bit_count(self._word(i).bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks) if m]
        return reduce(lambda a, b: a + b, parts, F.lit(0)).cast("int")

    def any_of(self, *names: str) -> Column:
        return self.at_least(1, *names)

    def all_of(self, *names: str) -> Column:
        return self.at_least(len(set(names)), *names) if names else F.lit(True)

    def none_of(self, *names: str) -> Column:
        return ~self.any_of(*names) if names else F.lit(True)

    def only_in(self, *names: str) -> Column:
        """In each of some sources and in no other."""
        return self.all_of(*names) & self.none_of(*[s for s in self.sources if s not in names])

    def at_least(self, n: int, *names: str) -> Column:
        return self.count(*names) >= n if names else F.lit(n <= 0)


def members_of(rows: DataFrame, source: str = "source") -> Members:
    """All sources of some rows, in order of their names: one name for each comes to the driver."""
    return Members([r[0] for r in rows.select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).collect()])
