"""The 128-bit variant identifier as Column functions.

From the highest bit: linear position (32), assembly (2), REF mode (1), REF payload (46), ALT mode (1),
ALT payload (46). It is kept as BINARY(16), which Spark compares byte by byte without sign, so that
order is genomic order; its text form is lower-case hex.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuskey.functions.alleles import LENGTH_FLAG, allele_bases, allele_fingerprint, allele_length, encode_slot, is_exact
from locuskey.functions.assembly import ASSEMBLIES, LENGTHS, OFFSETS, _col, assembly_name, chrom_name, linear_index, linear_offset, linear_position

#: Fixed value: the namespace of the identifiers' version-5 UUIDs, the UUID of the name "UVID" under the OID namespace.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_OID, "UVID")


def _word(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def compose_key(linear, code, ref_slot, alt_slot) -> Column:
    """Undashed hex of an identifier's parts; null if a part is null. The parts are best columns of their own, each read once here."""
    r = _col(ref_slot)
    high = F.shiftleft(_col(linear), 32).bitwiseOR(F.shiftleft(_col(code).cast("long"), 30)).bitwiseOR(F.shiftright(r, 17))
    low = F.shiftleft(r, 47).bitwiseOR(_col(alt_slot))
    return F.lower(F.concat(_word(high), _word(low)))


def encode_key(index, pos, ref, alt, code) -> Column:
    """Undashed hex of a variant's identifier; null where the contig or the position is invalid."""
    return compose_key(linear_position(index, pos, code), code, encode_slot(ref), encode_slot(alt))


def encode(index, pos, ref, alt, code) -> Column:
    """BINARY(16) identifier; null where the contig or the position is invalid."""
    return F.unhex(encode_key(index, pos, ref, alt, code))


def key_of(binary) -> Column:
    """Undashed lower-case hex of a BINARY identifier."""
    return F.lower(F.hex(_col(binary)))


def _hyphened(*parts: Column) -> Column:
    """Parts with hyphens between; null if one is."""
    return F.concat(*[x for p in parts for x in (F.lit("-"), p)][1:])


def dashed(key) -> Column:
    """8-8-8-8 form of 32 hex digits; null for a null."""
    k = _col(key)
    return _hyphened(*[F.substring(k, 8 * i + 1, 8) for i in range(4)])


def parse_key(text) -> Column:
    """32 hex digits of a lenient text form: other characters are skipped, fewer digits are zero-extended; none or too many give null."""
    digits = F.lower(F.regexp_replace(_col(text), "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits).between(1, 32), F.lpad(digits, 32, "0"))


def _words(key: Column) -> list[Column]:
    return [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def linear_of(key) -> Column:
    return _words(_col(key))[0]


def decoded_parts(w1: Column, w2: Column, w3: Column) -> tuple[Column, Column, Column]:
    """(assembly code, REF code, ALT code) of an identifier's words after the first."""
    one, flag = F.lit(1).cast("long"), F.lit(LENGTH_FLAG)
    allele = lambda mode, payload: F.when(mode == 1, payload.bitwiseOR(flag)).otherwise(payload)
    return (
        F.shiftright(w1, 30).bitwiseAND(F.lit(3).cast("long")).cast("int"),
        allele(F.shiftright(w1, 29).bitwiseAND(one), F.shiftleft(w1.bitwiseAND(F.lit(0x1FFFFFFF)), 17).bitwiseOR(F.shiftright(w2, 15))),
        allele(F.shiftright(w2, 14).bitwiseAND(one), F.shiftleft(w2.bitwiseAND(F.lit(0x3FFF)), 32).bitwiseOR(w3)),
    )


def decoded_fields(linear: Column, index: Column, code: Column, r: Column, a: Column) -> Column:
    """Struct of a variant's fields; null if the contig is."""
    fields = F.struct(
        chrom_name(index).alias("chr"),
        (linear - linear_offset(index, code)).alias("pos"),
        allele_bases(r).alias("ref"),
        allele_bases(a).alias("alt"),
        allele_length(r).alias("ref_len"),
        allele_length(a).alias("alt_len"),
        is_exact(r).alias("ref_is_exact"),
        is_exact(a).alias("alt_is_exact"),
        allele_fingerprint(r).alias("ref_fingerprint"),
        allele_fingerprint(a).alias("alt_fingerprint"),
        assembly_name(code).alias("assembly"),
    )
    return F.when(index.isNotNull(), fields)


def with_decoded(rows: DataFrame, key: str = "key", into: str = "decoded") -> DataFrame:
    """``rows`` with a struct of a variant's fields from 32 hex digits; null if the assembly or the position is invalid.

    Alleles known only by length come back as as many N. The steps are projections of their own, so that
    nothing is worked out twice.
    """
    w = rows.withColumns({f"_w{i}": x for i, x in enumerate(_words(F.col(key)))})
    parts = w.withColumns(dict(zip(("_asm", "_rc", "_ac"), decoded_parts(F.col("_w1"), F.col("_w2"), F.col("_w3")), strict=True)))
    parts = parts.withColumn("_ci", linear_index("_w0", "_asm"))
    fields = decoded_fields(*(F.col(c) for c in ("_w0", "_ci", "_asm", "_rc", "_ac")))
    return parts.withColumn(into, fields).drop(*[f"_w{i}" for i in range(4)], "_asm", "_rc", "_ac", "_ci")


def name_digest(key) -> Column:
    """SHA-1 of the fixed namespace and an identifier's 16 bytes, from which its UUID is cut."""
    return F.sha1(F.unhex(F.concat(F.lit(NAMESPACE.hex), _col(key))))


def uuid5(key) -> Column:
    """The version-5 UUID of an identifier's 16 bytes under the fixed namespace."""
    return uuid5_of(name_digest(key))


def uuid5_of(digest) -> Column:
    """The version-5 UUID that begins with a digest; the digest is best a column of its own, read once here."""
    h = _col(digest)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return _hyphened(F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def region_bounds(index: int, start: int, end: int, code: int) -> tuple[str, str, int, int]:
    """(lowest key, highest key, lowest linear, highest linear) of the variants at start..end of a contig, both ends included."""
    name = ASSEMBLIES[code]
    length = LENGTHS[name][index]
    if not (1 <= start <= length and 1 <= end <= length):
        raise ValueError(f"positions {start}-{end} are not on a contig of {length} bases")
    low, high = OFFSETS[name][index] + start, OFFSETS[name][index] + end
    asm = code << 94
    return f"{low << 96 | asm:032x}", f"{high << 96 | asm | (1 << 94) - 1:032x}", low, high


def region_bounds_cols(index, start, end, code) -> tuple[Column, Column]:
    """Lowest and highest key of a region for columns; null if an end isn't on the contig."""
    c = _col(code).cast("long")
    word = lambda x: F.lpad(F.hex(x), 8, "0")
    low, high = linear_position(index, start, code), linear_position(index, end, code)
    sound = low.isNotNull() & high.isNotNull()
    a = F.shiftleft(c, 30)
    return (
        F.when(sound, F.lower(F.concat(word(low), word(a), F.lit("0" * 16)))),
        F.when(sound, F.lower(F.concat(word(high), word(a.bitwiseOR(F.lit(0x3FFFFFFF))), F.lit("f" * 16)))),
    )
