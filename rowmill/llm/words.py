"""Words of UTF-8 texts and their 64-bit hashes, for many texts at once in NumPy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes whose prefix sums are held at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (multiply and shift)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are neither ASCII letters or digits nor part of a longer character.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE, PIECE + 1), _powers(pow(_BASE, -1, 2**64), PIECE + 1)


def lowered(values: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[values]


def word_bounds(values: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the number of words before each text.

    ``gaps`` marks the bytes between words: by default blank and tab to carriage return.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = (_SPACE if gaps is None else gaps)[values]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:n] |= gap[:-1] | gap[1:]
    cut[n] = True
    starts = np.flatnonzero(cut[:-1] & ~gap)
    ends = np.flatnonzero(cut[1:] & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice that depends on its bytes alone: differences of a polynomial's prefix sums, modulo 2^64."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = int(starts[k])
        if ends[k] - base > PIECE:  # a single word longer than the piece
            out[k] = int.from_bytes(hashlib.blake2b(values[base:ends[k]].tobytes(), digest_size=8).digest(), "little")
            k += 1
            continue
        stop = int(np.searchsorted(ends, base + PIECE, "right"))
        part = values[base:ends[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[:len(part)], out=sums[1:])
        s, e = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = mix((sums[e] - sums[s]) * _INVERSE[s] + (e - s).astype(np.uint64))
        k = stop
    return out
