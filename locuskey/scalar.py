"""Identifiers one at a time, in plain Python: the ``VariantId`` class, and a second oracle for the tests."""

from __future__ import annotations

import uuid
from functools import total_ordering

from locuskey.functions.assembly import ASSEMBLIES, LENGTHS, NAME_INDEX, NAMES, OFFSETS, parse_assembly_name
from locuskey.functions.ids import NAMESPACE, region_bounds

_BASES = "ACGT"


def fingerprint(seq: str) -> int:
    h = 0
    for c in seq.encode().decode("latin-1"):
        h = (((h << 2) | max(_BASES.find(c.upper()), 0)) & 0x1FFFF) ^ ((h >> 15) * 9)
    return h


def encode_allele(seq: str) -> int:
    if seq in ("", "."):
        return 0
    up = seq.upper()
    if len(up) <= 20 and set(up) <= set(_BASES):
        bits = 0
        for c in up:
            bits = bits << 2 | _BASES.index(c)
        return len(up) << 40 | bits << 2 * (20 - len(up))
    return 1 << 45 | len(seq) << 17 | fingerprint(seq)


def decode_allele(code: int) -> tuple[str, int, bool, int | None]:
    """(bases, length, exact, fingerprint)."""
    if code >> 45:
        n = (code & (1 << 45) - 1) >> 17
        return "N" * n, n, False, code & 0x1FFFF
    n = code >> 40
    return "".join(_BASES[code >> 2 * (19 - i) & 3] for i in range(n)), n, True, None


@total_ordering
class VariantId:
    """A 128-bit identifier; order is genomic order."""

    __slots__ = ("value",)

    def __init__(self, value: int):
        if not 0 <= value < 1 << 128:
            raise ValueError("not a 128-bit number")
        self.value = value

    @classmethod
    def encode(cls, chrom: str, pos: int, ref: str, alt: str, assembly: str = "GRCh38") -> VariantId:
        code = parse_assembly_name(assembly)
        index = NAME_INDEX.get(chrom.removeprefix("chr"))
        if index is None:
            raise ValueError(f"unknown chromosome: {chrom}")
        name = ASSEMBLIES[code]
        if not 1 <= pos <= LENGTHS[name][index]:
            raise ValueError(f"position {pos} is not on {chrom}")
        r, a = encode_allele(ref), encode_allele(alt)
        low = lambda c: c & (1 << 45) - 1
        return cls((OFFSETS[name][index] + pos) << 96 | code << 94 | (r >> 45) << 93 | low(r) << 47 | (a >> 45) << 46 | low(a))

    def decode(self) -> dict | None:
        v = self.value
        linear, code = v >> 96, v >> 94 & 3
        if code > 1:
            return None
        name = ASSEMBLIES[code]
        if not 0 < linear <= OFFSETS[name][24] + LENGTHS[name][24]:
            return None
        index = max(i for i, o in enumerate(OFFSETS[name]) if o < linear)
        r = decode_allele((v >> 93 & 1) << 45 | v >> 47 & (1 << 46) - 1)
        a = decode_allele((v >> 46 & 1) << 45 | v & (1 << 46) - 1)
        return {
            "chr": NAMES[index], "pos": linear - OFFSETS[name][index], "ref": r[0], "alt": a[0], "ref_len": r[1], "alt_len": a[1],
            "ref_is_exact": r[2], "alt_is_exact": a[2], "ref_fingerprint": r[3], "alt_fingerprint": a[3], "assembly": name,
        }

    @classmethod
    def from_hex(cls, text: str) -> VariantId:
        digits = "".join(c for c in text if c in "0123456789abcdefABCDEF")
        if not 1 <= len(digits) <= 32:
            raise ValueError(f"not an identifier: {text}")
        return cls(int(digits, 16))

    @classmethod
    def from_int(cls, value: int) -> VariantId:
        return cls(value)

    @staticmethod
    def range(chrom: str, start: int, end: int, assembly: str = "GRCh38") -> tuple[VariantId, VariantId]:
        index = NAME_INDEX.get(chrom.removeprefix("chr"))
        if index is None:
            raise ValueError(f"unknown chromosome: {chrom}")
        low, high, _, _ = region_bounds(index, start, end, parse_assembly_name(assembly))
        return VariantId(int(low, 16)), VariantId(int(high, 16))

    def to_hex(self) -> str:
        h = f"{self.value:032x}"
        return "-".join(h[i : i + 8] for i in range(0, 32, 8))

    def as_int(self) -> int:
        return self.value

    def uuid5(self) -> str:
        import hashlib

        digest = hashlib.sha1(NAMESPACE.bytes + self.value.to_bytes(16, "big")).digest()
        return str(uuid.UUID(bytes=digest[:16], version=5))

    def __eq__(self, other):
        return isinstance(other, VariantId) and self.value == other.value

    def __lt__(self, other):
        return self.value < other.value

    def __hash__(self):
        return hash(self.value)

    def __int__(self):
        return self.value

    def __str__(self):
        return self.to_hex()

    def __repr__(self):
        return f"VariantId({self.to_hex()})"
