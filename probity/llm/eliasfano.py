"""Elias-Fano coding of increasing 64-bit integers, with vectorised access and successor search.

The upper bits stand in a unary bit vector (two bits an element at most), the lower bits in a
packed array; a count of zeros stands before each word of the vector. All parts are plain arrays
in one buffer, so that a file can be memory-mapped and searched in place.
"""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64
EACH_BYTE, HIGH_BITS = U64(0x0101010101010101), U64(0x8080808080808080)
#: The place of one number r in byte b, at 8 b + r.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)])


def pack(arrays: dict[str, np.ndarray], **head) -> bytes:
    """One buffer: length of the header, header as JSON, arrays at 8-byte borders."""
    at, parts, table = 0, [], {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        table[name] = [str(a.dtype), len(a), at]
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    text = json.dumps({"arrays": table, "head": head}).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def unpack(buffer) -> tuple[dict[str, np.ndarray], dict]:
    """Views into ``buffer`` (bytes or a memory map); nothing is copied."""
    n = int.from_bytes(buffer[:8], "little")
    info = json.loads(bytes(buffer[8 : 8 + n]))
    return {k: np.frombuffer(buffer, kind, count, 8 + n + at) for k, (kind, count, at) in info["arrays"].items()}, info["head"]


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays ``low``, ``high``, ``zeros`` and ``meta`` of non-decreasing ``values`` under ``universe``."""
    values = np.asarray(values, U64)
    n = len(values)
    width = max(0, (int(universe) // max(1, n)).bit_length() - 1)
    low = _pack_low(values, width)
    top = values >> U64(width)
    buckets = (int(universe) >> width) + 1
    words = (n + buckets + 1) // 64 + 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(top + np.arange(n, dtype=U64)).astype(np.int64)] = 1
    high = np.packbits(bits, bitorder="little").view(U64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))[:-1]]).astype(np.int64)
    return {"low": low, "high": high, "zeros": zeros, "meta": np.array([n, width, buckets], np.int64)}


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The lower ``width`` bits of each value, one after the other."""
    out = np.zeros(len(values) * width // 64 + 3, U64)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.int64) * width
        word, off = bit >> 6, (bit & 63).astype(U64)
        low = values & U64((1 << width) - 1)
        first = np.flatnonzero(np.diff(word, prepend=-1))  # every word has a value that begins in it
        out[word[first]] = np.bitwise_or.reduceat(low << off, first)
        over = np.flatnonzero(off + U64(width) > U64(64))
        out[word[over] + 1] |= low[over] >> (U64(64) - off[over])
    return out


class EliasFano:
    """Reads what ``encode`` made. ``get`` gives values by position, ``find`` positions by value."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = "") -> None:
        self.low, self.high, self.zeros = (arrays[prefix + k] for k in ("low", "high", "zeros"))
        self.n, self.width, self.buckets = map(int, arrays[prefix + "meta"])
        self.mask = U64((1 << self.width) - 1)
        self.ones = np.arange(len(self.zeros)) * 64 - self.zeros

    def lower(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), U64)
        bit = at.astype(U64) * U64(self.width)
        word, off = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        left = np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return ((self.low[word] >> off) | left) & self.mask

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of number ``k`` (from 0) of the ones, or with ``flip`` of the zeros."""
        at = np.searchsorted(before, k, side="right") - 1
        rest, word = (k - before[at]).astype(U64), self.high[at]
        if flip:
            word = ~word
        # ones up to each byte of the word, then the byte that holds the one wanted, then its place there
        sums = word - ((word >> U64(1)) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * EACH_BYTE
        byte = np.bitwise_count(((rest * EACH_BYTE | HIGH_BITS) - sums) & HIGH_BITS).astype(U64) * U64(8)
        rest = rest - (((sums << U64(8)) >> byte) & U64(255))
        return at * 64 + byte.astype(np.int64) + IN_BYTE[((word >> byte) & U64(255)) * U64(8) + rest]

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        top = (self._select(at, self.ones, False) - at).astype(U64)
        return (top << U64(self.width)) | self.lower(at)

    def get_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at positions (not the last) and at those that follow; the second one comes from
        the next bit that is set."""
        at = np.asarray(at, np.int64)
        place = self._select(at, self.ones, False)
        bits = self._bits_from(place + 1)
        after = place + 1 + np.bitwise_count((bits & (~bits + U64(1))) - U64(1)).astype(np.int64)
        if (far := np.flatnonzero(bits == 0)).size:
            after[far] = self._select(at[far] + 1, self.ones, False)
        width = U64(self.width)
        return ((place - at).astype(U64) << width) | self.lower(at), ((after - at - 1).astype(U64) << width) | self.lower(at + 1)

    def _bits_from(self, place: np.ndarray) -> np.ndarray:
        """64 bits of the unary vector from each place on."""
        word, off = place >> 6, (place & 63).astype(U64)
        return (self.high[word] >> off) | np.where(off > 0, self.high[word + 1] << ((U64(64) - off) & U64(63)), U64(0))

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """Positions of ``values`` (-1: none) among those from ``first`` up to ``end``.

        Successor search: the run of ones that the upper bits name, cut to that range, then a
        binary search of the lower bits.
        """
        x = np.asarray(values, U64)
        out = np.full(len(x), -1, np.int64)
        top, low = (x >> U64(self.width)).astype(np.int64), x & self.mask
        inside = (top >= 0) & (top < self.buckets)
        if not self.n or not inside.any():
            return out
        top = np.where(inside, top, 0)
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, True) + 1, 0)
        lo = start - top
        bits = ~self._bits_from(start)
        hi = lo + np.bitwise_count((bits & (~bits + U64(1))) - U64(1)).astype(np.int64)
        if (long := np.flatnonzero(bits == 0)).size:
            hi[long] = self._select(top[long], self.zeros, True) - top[long]
        lo, hi = np.maximum(lo, first), np.minimum(hi, self.n if end is None else end)
        stop = hi.copy()
        live = np.flatnonzero((lo < hi) & inside)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.lower(mid) < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        some = np.flatnonzero((lo < stop) & inside)
        hit = self.lower(lo[some]) == low[some]
        out[some[hit]] = lo[some[hit]]
        return out
