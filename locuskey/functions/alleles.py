"""Allele codes: 46 bits, exact for up to 20 bases, else a length and a 17-bit fingerprint."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from locuskey.functions.assembly import _col

EXACT_BASES = 20
LENGTH_FLAG = 1 << 45
PAYLOAD = (1 << 45) - 1
FINGERPRINT_BITS = 17
#: Bases that a step of the fingerprint takes in: 40 bits, beside the 23 that it has.
STEP_BASES = 20
#: Bits after which the powers of two repeat modulo the fingerprint's polynomial, which is primitive; bytes of texts that are looked at once.
_PERIOD, _AT_ONCE = (1 << FINGERPRINT_BITS) - 1, 1 << 17


def valid_dna(seq) -> Column:
    """Only A, C, G, T in any case; true for the empty text."""
    return _col(seq).rlike("^[ACGTacgt]*$")


def encode_base(base) -> Column:
    """0..3 for A, C, G, T in any case; null for anything else."""
    at = F.instr(F.lit("ACGT"), F.upper(_col(base)))
    return F.when((F.length(_col(base)) == 1) & (at > 0), at - 1)


def decode_base(code) -> Column:
    return F.get(F.array(*map(F.lit, "ACGT")), _col(code).cast("int"))


def encode_bases(seq, most: int = EXACT_BASES) -> Column:
    """Bases as base-4 digits, the first ``most`` of them, left-aligned in 2 * ``most`` bits (most <= 31); null if another letter is among them."""
    s = F.upper(F.substring(_col(seq), 1, most))
    digits = F.rpad(F.translate(s, "ACGT", "0123"), most, "0")
    return F.when(s == "", F.lit(0).cast("long")).when(s.rlike("^[ACGT]*$"), F.conv(digits, 4, 10).cast("long"))


def decode_bases(code, length, most: int = EXACT_BASES) -> Column:
    n = _col(length).cast("int")
    digits = F.lpad(F.conv(_col(code).cast("string"), 10, 4), most, "0")
    return F.translate(F.substring(digits, F.lit(1), n), "0123", "ACGT")


def fingerprint(seq) -> Column:
    """Remainder of the bases (two bits each, others 0) modulo x^17 + x^3 + 1: one digit per UTF-8 byte; case counts for no base.

    A step takes STEP_BASES digits in. x^17 is x^3 + 1, x^34 is x^6 + 1 and x^51 is x^9 + x^6 + x^3 + 1, so a step leaves 23 bits, which
    the next one takes on as they are; the last six of them are folded at the end.
    """
    s = _col(seq).cast("string")
    letters = F.when(F.octet_length(s) == F.length(s), s).otherwise(F.decode(s.cast("binary"), "ISO-8859-1"))
    digits = F.translate(F.regexp_replace(letters, "[^ACGTacgt]", "A"), "ACGTacgt", "01230123")
    # Zeros in front change nothing.
    even = F.lpad(digits, (F.ceil(F.octet_length(s) / STEP_BASES) * STEP_BASES).cast("int"), "0")
    words = F.transform(F.regexp_extract_all(even, F.lit(f"[0-3]{{{STEP_BASES}}}"), F.lit(0)), lambda x: F.conv(x, 4, 10).cast("long"))
    mask = F.lit((1 << FINGERPRINT_BITS) - 1).cast("long")

    def step(h: Column, x: Column) -> Column:
        v = F.shiftleft(h, 2 * STEP_BASES).bitwiseXOR(x)
        part = lambda i: F.shiftright(v, FINGERPRINT_BITS * i).bitwiseAND(mask)
        by_one, by_two = part(1).bitwiseXOR(F.shiftright(v, 51)), part(2).bitwiseXOR(F.shiftright(v, 51))
        high = F.shiftleft(by_one, 3).bitwiseXOR(F.shiftleft(by_two, 6)).bitwiseXOR(F.shiftleft(F.shiftright(v, 51), 9))
        return part(0).bitwiseXOR(by_one).bitwiseXOR(part(2)).bitwiseXOR(high)

    def last(h: Column) -> Column:
        over = F.shiftright(h, FINGERPRINT_BITS)
        return h.bitwiseAND(mask).bitwiseXOR(over).bitwiseXOR(F.shiftleft(over, 3))

    return F.aggregate(words, F.lit(0).cast("long"), step, last)


@lru_cache
def _digit_values():
    """The remainder of each digit 1, 2, 3 at each place, in one row after another; places repeat after 2^17 - 1 bits."""
    import numpy as np

    powers, v = np.empty(_PERIOD, np.int32), 1
    for i in range(_PERIOD):
        powers[i] = v
        v <<= 1
        v ^= (1 << FINGERPRINT_BITS | 9) if v >> FINGERPRINT_BITS else 0
    return np.concatenate([np.zeros(_PERIOD, np.int32), powers, np.roll(powers, -1), powers ^ np.roll(powers, -1)])


def fingerprints(texts):
    """``fingerprint`` of each text of an Arrow array; null for a null. A base costs some nanoseconds, against some hundred in a Column expression."""
    import numpy as np
    import pyarrow as pa

    a = texts.cast(pa.large_string())
    ends = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    digit = np.zeros(256, np.int32)
    for i, letters in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
        digit[list(letters)] = i * _PERIOD
    values, out = _digit_values(), np.zeros(len(a), np.int64)
    row = 0
    while row < len(a):
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + _AT_ONCE, "right")) - 1)
        sizes = np.diff(ends[row : to + 1])
        full = np.flatnonzero(sizes)
        if len(full):
            first = ends[row]
            place = np.repeat((ends[row + 1 : to + 1] - first).astype(np.int32), sizes)
            place -= np.arange(1, len(place) + 1, dtype=np.int32)
            place <<= 1
            if sizes.max() * 2 > _PERIOD:
                place %= _PERIOD
            place += digit.take(data[first : ends[to]])
            out[row + full] = np.bitwise_xor.reduceat(values.take(place), ends[row:to][full] - first)
        row = to
    return pa.array(out, pa.int64(), mask=np.asarray(a.is_null()))


def _code(seq, flag: int, made=None) -> Column:
    s = F.coalesce(_col(seq), F.lit(""))
    n = F.length(s).cast("long")
    exact = F.shiftleft(n, 40).bitwiseOR(F.conv(F.rpad(F.translate(F.upper(s), "ACGT", "0123"), EXACT_BASES, "0"), 4, 10).cast("long"))
    by_length = F.shiftleft(n, FINGERPRINT_BITS).bitwiseOR(fingerprint(s) if made is None else F.coalesce(_col(made), fingerprint(s))).bitwiseOR(F.lit(flag))
    # Nearly all alleles are one base.
    base = F.instr(F.lit("ACGTacgt"), s)
    single = F.lit(1 << 40) + F.shiftleft(F.pmod(base - 1, F.lit(4)).cast("long"), 38)
    return F.when((n == 1) & (base > 0), single).when(s.isin("", "."), F.lit(0).cast("long")).when((n <= EXACT_BASES) & s.rlike(f"^[ACGTacgt]{{1,{EXACT_BASES}}}$"), exact).otherwise(by_length)


def encode_allele(seq) -> Column:
    """The code of an allele; 0 for the missing allele (null, empty or ``.``)."""
    return _code(seq, LENGTH_FLAG)


def encode_slot(seq, made=None) -> Column:
    """The code as it lies in an identifier: the mode a bit higher, above a spare bit. ``made`` is the allele's fingerprint where it is known already, else null."""
    return _code(seq, LENGTH_FLAG << 1, made)


def is_exact(code) -> Column:
    return F.shiftright(_col(code), 45) == 0


def allele_length(code) -> Column:
    c = _col(code)
    return F.when(is_exact(c), F.shiftright(c, 40)).otherwise(F.shiftright(c.bitwiseAND(F.lit(PAYLOAD)), FINGERPRINT_BITS)).cast("int")


def allele_fingerprint(code) -> Column:
    """The fingerprint of an allele known by its length; null for an exact one."""
    c = _col(code)
    return F.when(~is_exact(c), c.bitwiseAND(F.lit((1 << FINGERPRINT_BITS) - 1))).cast("int")


def allele_bases(code, fill: bool = True) -> Column:
    """The bases; for an allele known by its length as many N, or null if not ``fill``."""
    c = _col(code)
    exact = decode_bases(c.bitwiseAND(F.lit((1 << 40) - 1)), allele_length(c))
    return F.when(is_exact(c), exact).otherwise(F.repeat(F.lit("N"), allele_length(c)) if fill else F.lit(None).cast("string"))


def reverse_complement(seq) -> Column:
    """Upper-case reverse complement; what isn't A, C, G or T becomes N."""
    return F.translate(F.regexp_replace(F.reverse(F.upper(_col(seq))), "[^ACGT]", "N"), "ACGT", "TGCA")
