"""Boundaries of byte-level pre-tokens without a regular expression.

Every code point gets a class from an array. Whether a token starts at a character then follows from its class and its
neighbours': a run of a class starts one, the last white space of a run is apart, a blank there goes with what follows, and an
apostrophe that starts a token takes a suffix with it. So the boundaries of many texts are found at once in NumPy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from rowmill.llm.words import mix, slice_hashes

LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE = range(6)
# fixed values: white space of the Unicode standard, and what may follow an apostrophe
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIX_1, SUFFIX_2 = "stmd", ["re", "ve", "ll"]

#: A length of runs that tests cross.
ROW = 256
# what runs together: apostrophes are like other signs, blanks like white space
_RUN = np.array([LETTER, NUMBER, OTHER, OTHER, SPACE, SPACE], np.uint8)
# the first 0 to 8 bytes of a little-endian word
_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def codepoint_classes(probe: Callable[[list[str]], np.ndarray] | None = None) -> np.ndarray:
    """The class of every code point by its general category.

    ``probe`` tells of characters that this Python's Unicode tables do not know whether a library takes them for
    letters (1), numbers (2) or neither (0).
    """
    table = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            table[point] = LETTER
        elif kind[0] == "N":
            table[point] = NUMBER
        elif kind == "Cn" and point < 0xE0000:
            unknown.append(point)
    if probe is not None:
        found = np.asarray(probe([chr(p) for p in unknown]))
        table[np.array(unknown)[found == 1]] = LETTER
        table[np.array(unknown)[found == 2]] = NUMBER
    table[WHITE_SPACE] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def codepoints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the position of each one's first byte."""
    high = values >= 0x80
    if not high.any():
        return values.astype(np.int32), np.arange(len(values))
    starts = np.flatnonzero((values & 0xC0) != 0x80)
    points = values[starts].astype(np.int32)
    long = np.flatnonzero(points >= 0xC0)
    lead, at = points[long], starts[long]
    rest = np.concatenate([values, np.zeros(3, np.uint8)])
    one, two, three = ((rest[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
    points[long] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(
        lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
    return points, starts


def bounds(values: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, with the end of the last one, and pre-tokens before each text."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points, starts = codepoints(values)
    n = len(points)
    kind = classes.take(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(starts, offsets)] = True
    first[n] = True
    white = kind >= BLANK
    more_white = np.ones(n, bool)  # the next character is white space, or there is none in this text
    more_white[:-1] = white[1:]
    more_white |= first[1:]
    last = white & ~more_white  # the last one goes apart from those before it, a blank with what follows
    run = _RUN.take(kind)
    new = np.ones(n, bool)
    new[1:] = run[1:] != run[:-1]
    new |= last
    new[np.flatnonzero(last & (kind == BLANK)) + 1] = False
    new |= first[:-1]
    quotes = np.flatnonzero((kind == QUOTE) & new)
    if len(quotes):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside_1 = ~first[quotes + 1]
        inside_2 = inside_1 & ~first[np.minimum(quotes + 2, n)]
        after = np.append(new, [True] * 3)
        for size, found in ((2, inside_1 & np.isin(one, [ord(c) for c in SUFFIX_1])),
                            *((3, inside_2 & (one == ord(a)) & (two == ord(b))) for a, b in SUFFIX_2)):
            after[quotes[found] + 1] = False
            after[quotes[found] + size] = True
        new = after[:n]
    cut = starts[new]
    return np.append(cut, len(values)), np.searchsorted(cut, offsets)


def _words(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every slice: its bytes themselves, if these are 16 at most; hashes of longer ones."""
    padded = np.concatenate([values, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes at every position
    size = ends - starts
    low = eight[starts] & _MASKS.take(np.minimum(size, 8))
    high = eight[starts + 8 * (size > 8)] & _MASKS.take(np.clip(size - 8, 0, 8))
    long = np.flatnonzero(size > 16)
    if len(long):
        own = size[long]
        ends = np.cumsum(own)
        some = values[np.arange(ends[-1]) + np.repeat(starts[long] - (ends - own), own)]
        low[long], high[long] = slice_hashes(some, ends - own, ends), slice_hashes(some ^ 0x55, ends - own, ends)
    return low, high


def distinct(values: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first occurrence of every distinct pre-token, and for each pre-token the number of its own.

    Pre-tokens are told apart by their size and 128 bits, their bytes or hashes of long ones: they are grouped by the upper bits of
    a hash of these, sorted with their numbers in the lower bits, and must agree with the first of their group.
    """
    starts, ends = cut[:-1], cut[1:]
    n, size = len(starts), ends - starts
    low, high = _words(values, starts, ends)
    bits = np.uint64(n.bit_length())
    order = np.sort(mix(low ^ mix(high + size.astype(np.uint64))) >> bits << bits | np.arange(n, dtype=np.uint64))
    key = order >> bits
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first, number = order[new], np.empty(n, np.int64)
    number[order] = np.cumsum(new) - 1
    same = first[number]
    if (low[same] != low).any() or (high[same] != high).any() or (size[same] != size).any():
        told = np.stack([low, high, size.astype(np.uint64)])
        _, first, number = np.unique(told, axis=1, return_index=True, return_inverse=True)
        number = number.ravel()
    return first, number


def spread(flat: np.ndarray, own: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens, one after the other, and ids per pre-token; ``flat`` has the ids of the distinct ones,
    ``own`` how many each of these has."""
    sizes = own[number]
    ends = np.cumsum(sizes)
    shift = (np.cumsum(own) - own)[number] - (ends - sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, sizes)], sizes
