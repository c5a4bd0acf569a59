"""Words of many texts at once, as hashes, in numpy.

A word is a maximal run of bytes other than space and the five ASCII blanks x09 to x0D. Its hash is a polynomial
over its bytes, then mixed; words of over ``LONG`` bytes are hashed by blake2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import KEPT

LONG = 1 << 16
_SPAN = 1 << 17  # bytes, or words, that are hashed at a time
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything of ASCII but letters and digits.
ALPHANUMERIC_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}
KEPT.append(_powers)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1024), base, dtype=np.uint64)
        full[0] = 1
        have = _powers[int(base)] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their offsets) of a string column without nulls."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + 1, offset=8 * wide.offset) if len(wide) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8) if wide.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its end, number of words before each text and in all)."""
    solid = ~gaps[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    last = solid
    last[:-1] &= ~solid[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    base, back = powers(_BYTE_BASE, _SPAN + LONG + 1), powers(inverse(_BYTE_BASE), _SPAN + LONG + 1)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _SPAN)))
        at = int(starts[a])
        long = np.flatnonzero(ends[a:b] - starts[a:b] > LONG)
        if len(long):
            b = a + int(long[0])
            if b == a:
                out[a] = np.uint64(int.from_bytes(hashlib.blake2b(data[at : ends[a]].tobytes(), digest_size=8).digest(), "little"))
                a += 1
                continue
        s, e = starts[a:b] - at, ends[a:b] - at
        run = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum((data[at : at + len(run) - 1].astype(np.uint64) + np.uint64(1)) * base[: len(run) - 1], out=run[1:])
        out[a:b] = mix((run[e] - run[s]) * back[s])
        a = b
    return out


def windows(words: np.ndarray, counts: np.ndarray, size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every ``size`` consecutive words of one text, and the index of its first word.

    counts: number of words before each text and in all, from ``spans``.
    """
    inside = np.zeros(len(words) + 1, dtype=np.int8)
    long = np.diff(counts) >= size
    inside[counts[:-1][long]] += 1
    inside[counts[1:][long] - size + 1] -= 1
    first = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    out = np.empty(len(first), dtype=np.uint64)
    forth, back = powers(base, _SPAN + size), powers(inverse(base), _SPAN)
    for a in range(0, len(words), _SPAN):
        own = words[a : a + _SPAN + size]
        run = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(own * forth[: len(own)], out=run[1:])
        low, high = np.searchsorted(first, (a, a + _SPAN))
        at = first[low:high] - a
        out[low:high] = mix((run[at + size] - run[at]) * back[at])
    return out, first
