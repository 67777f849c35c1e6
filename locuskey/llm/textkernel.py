"""Vectorised word splitting and hashing over Arrow text buffers.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; such bytes never occur inside a
multi-byte UTF-8 character, so byte positions are safe cut points. All hashes are 64-bit and the
same on every machine and in every run: a word is a sum of random numbers drawn for each pair of byte
and place in the word, so that no arithmetic of one base makes different words equal, and what is
built from words (shingles, windows) is a polynomial over finalised word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text that are worked on at once, a text more at most.
CHUNK_BYTES = 1 << 20

_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Places in a word that have random numbers of their own; further on they are multiplied by one for each round.
_PLACES = 64

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_is_letter = np.zeros(256, bool)
_is_letter[[*range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters U+00C0 to U+00FF, without the signs of multiplication and division.
_ends_letter = np.zeros(256, bool)
_ends_letter[0x80:0xC0] = True
_ends_letter[[0x97, 0xB7]] = False
_in_lower_case = np.arange(256, dtype=np.uint8)
_in_lower_case[65:91] += 32
_constants = np.random.RandomState(20240229)
_plain = _constants.randint(-(2**63), 2**63 - 1, (_PLACES, 256), dtype=np.int64).view(np.uint64)
_lower = _plain.copy()
_lower[:, 65:91] = _plain[:, 97:123]
_plain, _lower = _plain.ravel(), _lower.ravel()


def finalise(x: np.ndarray) -> np.ndarray:
    """Avalanche mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            step = np.uint64(pow(int(self.base), len(self.up), 1 << 64))
            back = np.uint64(pow(int(self.inverse), len(self.down), 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step]), np.concatenate([self.down, self.down * back])
        return self.up[:n], self.down[:n]


_word_powers = _Powers(_WORD_BASE)

#: A prime, and a base below it whose powers are far from small numbers.
PRIME = np.uint64((1 << 61) - 1)
_PRIME_BASE = 0x1BD11BDAA9FC1A22 % ((1 << 61) - 1)
_LOW29, _LOW32 = np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)
_29, _32, _61 = np.uint64(29), np.uint64(32), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> _61) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, put together from halves."""
    ah, al, bh, bl = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    return _reduced(((ah * bh) << np.uint64(3)) + (middle >> _29) + ((middle & _LOW29) << _32) + (low >> _61) + (low & PRIME))


class _PrimePowers:
    """base**i and base**-i modulo PRIME, grown on demand by doubling."""

    def __init__(self, base: int):
        p = int(PRIME)
        self.bases = (base, pow(base, -1, p))
        self.tables = [np.ones(1, np.uint64) for _ in self.bases]

    def get(self, n: int) -> list[np.ndarray]:
        for i, base in enumerate(self.bases):
            while len(self.tables[i]) < n:
                t = self.tables[i]
                self.tables[i] = np.concatenate([t, times(t, np.full(len(t), pow(base, len(t), int(PRIME)), np.uint64))])
        return [t[:n] for t in self.tables]


_prime_powers = _PrimePowers(_PRIME_BASE)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def give_back() -> None:
    """Hands memory that a task's arrays no longer use back to the machine; workers live on and share it with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def spaces_but(others: bytes) -> np.ndarray:
    """Which bytes end words, if ``others`` of the usual ones do not."""
    mask = _is_space.copy()
    mask[list(others)] = False
    return mask


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of some non-empty runs of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _lower if lower else _plain
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    inside = np.repeat((starts - begin).astype(np.int32), size) + np.arange(len(place), dtype=np.int32)
    value = table[((place & (_PLACES - 1)) << 8) | data[inside]]
    if int(size.max()) > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        value[far] *= finalise((place[far] // _PLACES).astype(np.uint64)) | np.uint64(1)
    return finalise(np.add.reduceat(value, begin) + size.astype(np.uint64))


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a sample of each different run, for each run the index of its sample): by hash, and the bytes are compared."""
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    other = sample[which]
    same = size == size[other]
    rows = np.flatnonzero(same & (other != np.arange(len(other))))
    last = np.cumsum(size[rows])
    for a, b in chunks(np.zeros(0, np.uint8), np.concatenate([[0], last])):
        part, count = rows[a:b], size[rows[a:b]]
        spot = np.arange(int(count.sum()), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        own = np.repeat(starts[part].astype(np.int32), count) + spot
        its = np.repeat(starts[other[part]].astype(np.int32), count) + spot
        differ = data[own] != data[its]
        if differ.any():
            same[np.repeat(part, count)[differ]] = False
    odd = np.flatnonzero(~same)
    if len(odd):
        # Runs of one hash that differ stand for themselves.
        which = which.copy()
        which[odd] = len(sample) + np.arange(len(odd))
        sample = np.concatenate([sample, odd])
    return sample, which


class Words:
    """Words of some rows: byte positions, hashes, and each row's first word (``first`` has a row more).

    With ``gaps`` a word begins where the one before it ends, and what follows a row's last word is one more.
    With ``marks`` (which bytes are such) marks that end a word and follow an ASCII letter or one of U+00C0 to U+00FF are a word of their own,
    and words of ASCII letters alone are in lower case.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, spaces: np.ndarray = _is_space, gaps: bool = False, marks: np.ndarray | None = None):
        self.base = int(offsets[0])
        self.bytes = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        b, n = self.bytes, len(self.bytes)
        inside = ~spaces[b]
        begins, ends = inside.copy(), inside.copy()
        if n:
            edge = np.zeros(n + 1, bool)
            edge[self.offsets] = True
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if gaps:
            bounds = np.unique(np.concatenate([self.offsets, self.ends]))
            self.starts, self.ends = bounds[:-1], bounds[1:]
        if marks is not None and len(self.starts):
            last = np.maximum.accumulate(np.where(marks[b], -1, np.arange(n)))[self.ends - 1]
            letter = _is_letter[b[last]] | ((last > self.starts) & (b[last - 1] == 0xC3) & _ends_letter[b[last]])
            cut = np.flatnonzero((last >= self.starts) & (last + 1 < self.ends) & letter)
            self.starts = np.insert(self.starts, cut + 1, last[cut] + 1)
            self.ends = np.insert(self.ends, cut, last[cut] + 1)
            others = np.concatenate([[0], np.cumsum(~_is_letter[b], dtype=np.int32)])
            plain = others[self.ends] == others[self.starts]
            turn = np.zeros(n + 1, np.int8)
            turn[self.starts[plain]] += 1
            turn[self.ends[plain]] -= 1
            self.bytes = b = np.where(np.cumsum(turn[:n], dtype=np.int8).view(bool), _in_lower_case[b], b)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = hash_runs(self.bytes, self.starts, self.ends, lower)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all runs of ``width`` words inside one row, and the runs' first words."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _word_powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * up[:n], out=total[1:])
        at = np.arange(n - width + 1)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        at = at[at + width <= row_end[: n - width + 1]]
        return finalise((total[at + width] - total[at]) * down[at]), at

    def prime_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``windows`` with hashes modulo a prime: polynomials modulo a power of two are equal for whole families of sequences, those of two words in Thue-Morse order, whatever the base."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(n - width + 1)
        row_end = np.repeat(self.first[1:], np.diff(self.first))
        at = at[at + width <= row_end[: n - width + 1]]
        up, down = _prime_powers.get(n)
        terms = times(_reduced(self.hashes), up)
        # Sums of halves do not overflow.
        high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(terms >> _32, out=high[1:])
        np.cumsum(terms & _LOW32, out=low[1:])
        high, low = high[at + width] - high[at], low[at + width] - low[at]
        whole = _reduced((high >> _29) + ((high & _LOW29) << _32) + low)
        return finalise(times(whole, down[at])), at


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none make none."""
    all_, at = words.windows(width)
    cut = np.searchsorted(at, words.first)
    for r in range(len(words.first) - 1):
        n = words.first[r + 1] - words.first[r]
        if n >= width:
            yield np.unique(all_[cut[r] : cut[r + 1]])
        elif n:
            h = words.hashes[words.first[r] : words.first[r + 1]]
            up, _ = _word_powers.get(int(n) + 1)
            yield finalise(np.atleast_1d(np.sum(h * up[:n]) + np.uint64(n)))
        else:
            yield np.zeros(0, np.uint64)


_END = b"\xff"  # never in UTF-8


def squeeze(parts: list[bytes]) -> bytes:
    """Some UTF-8 texts, compressed together."""
    return zstandard.ZstdCompressor(level=1).compress(_END.join(parts))


def expand(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(_END)


def squeeze_ordered(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed steps, byte planes apart."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand_ordered(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel())


def joined(data: bytes) -> bytes:
    """The words of ``data``, one space between them."""
    return b" ".join(data.split())
