"""Which rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")), F.lit(folds))


def share_below(key: list[Column], share: Column, salt: int) -> Column:
    """True for about ``share`` of all different keys, always the same ones."""
    return F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(_GRAIN)) < share * F.lit(float(_GRAIN))


def bounded(rows: DataFrame, bound: int, salt: int) -> DataFrame:
    """About ``bound`` different rows, chosen by a hash of the whole row; all different rows if there are no more."""
    n = rows.count()
    return rows.where(share_below([F.col(c) for c in rows.columns], F.lit(min(1.0, bound / max(n, 1))), salt)).distinct()


def unused(names: list[str], like: str) -> str:
    """A name that isn't among ``names``, in any case of letters."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


def with_text(docs: DataFrame, new: set[str], text: str, keep_text: bool) -> tuple[DataFrame, list[str]]:
    """(``_row``, all columns but those of ``new`` as one; ``_text`` beside it unless it is among them, so that a text travels once) and the columns' names."""
    carried = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    own = F.col(f"`{text}`").cast("string")
    pad = unused(carried, "_pad")
    row = F.struct(*[own.alias(c) if c == text else F.col(f"`{c}`") for c in carried], F.lit(None).cast("int").alias(pad)).alias("_row")
    return docs.select(row, *([] if keep_text else [own.alias("_text")])), carried
